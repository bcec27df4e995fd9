"""The command line: ``python -m sketchloom.plans.cli COMMAND ...``."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions.aggregates import NUMERICAL, parse_aggregations
from sketchloom.operators import index as I
from sketchloom.operators.joins import combinations, task_part
from sketchloom.operators.sketch import SketchSpec, build_sketch
from sketchloom.plans import jobs
from sketchloom.plans.params import parse_index, parse_sketches
from sketchloom.session import tuned
from sketchloom.sources import store, synthetic, tables

COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], None], Callable[[argparse.ArgumentParser], None]]] = {}


def command(name: str, options: Callable[[argparse.ArgumentParser], None]):
    def add(run: Callable[[SparkSession, argparse.Namespace], None]):
        COMMANDS[name] = (run, options)
        return run

    return add


def all_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Column pairs of every table below a folder. The list of files is metadata, one job reads each table."""
    out = None
    for row in tables.find_tables(spark, folder).collect():
        name = row.path.rsplit("/", 1)[-1]
        pairs = tables.column_pairs(tables.scan(spark, row.path), name)
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        raise SystemExit(f"no .csv or .parquet below {folder}")
    return out


def _io(p: argparse.ArgumentParser) -> None:
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)


@command("create-store", _io)
def create_store(spark: SparkSession, a: argparse.Namespace) -> None:
    store.write_store(all_pairs(spark, a.input), a.output)


def _pairwise(p: argparse.ArgumentParser) -> None:
    _io(p)
    p.add_argument("--job", choices=["CORR_STATS", "CORR_PERF", "MI"], default="CORR_STATS")
    p.add_argument("--sketches", default="KMV:256")
    p.add_argument("--aggregates", default="")
    p.add_argument("--intra-dataset-combinations", action="store_true")
    p.add_argument("--max-columns", type=int, default=5000)
    p.add_argument("--total-tasks", type=int, default=1)
    p.add_argument("--task-id", type=int, default=0)


@command("pairwise", _pairwise)
def pairwise(spark: SparkSession, a: argparse.Namespace) -> None:
    """Estimates against exact joins for all pairs of columns of a store."""
    pairs = store.read_store(spark, a.input)
    ids = combinations(store.read_catalog(spark, a.input), a.intra_dataset_combinations, a.max_columns)
    ids = task_part(ids, a.total_tasks, a.task_id)
    specs = [s for agg in parse_aggregations(a.aggregates) for s in parse_sketches(a.sketches, agg)]
    if a.job == "CORR_STATS":
        out = jobs.correlation_stats(pairs, jobs.numeric_pairs(pairs, ids), specs)
    elif a.job == "CORR_PERF":
        out = jobs.performance_report(pairs, jobs.numeric_pairs(pairs, ids), specs)
    else:
        out = jobs.information_report(pairs, ids, specs)
    store.write_csv(out, a.output)


def _input(p: argparse.ArgumentParser) -> None:
    p.add_argument("--input", required=True)


@command("budget", _input)
def budget(spark: SparkSession, a: argparse.Namespace) -> None:
    keys = store.read_store(spark, a.input).select("dataset_id", "key_name", "k").distinct()
    jobs.budget_equivalence(keys).show()


@command("collisions", _input)
def collisions(spark: SparkSession, a: argparse.Namespace) -> None:
    jobs.collision_report(store.read_store(spark, a.input)).show()


def _build(p: argparse.ArgumentParser) -> None:
    _io(p)
    p.add_argument("--params", default="QCR:KEY:100:KMV:256")
    p.add_argument("--aggregate", default="MEAN")


@command("build-index", _build)
def build_index(spark: SparkSession, a: argparse.Namespace) -> None:
    params = parse_index(a.params, a.aggregate)[0]
    pairs = all_pairs(spark, a.input).filter(F.col("value_type") == NUMERICAL)
    I.save_index(a.output, build_sketch(pairs, params.sketch), params.kind)


def _query(p: argparse.ArgumentParser) -> None:
    p.add_argument("--index", required=True)
    p.add_argument("--table", required=True)
    p.add_argument("--columns", required=True, help="key:value")
    p.add_argument("--sort", choices=I.SORTS, default="KEY")
    p.add_argument("--top-k", type=int, default=100)
    p.add_argument("--budget", type=float, default=256)
    p.add_argument("--aggregate", default="MEAN")
    p.add_argument("--output", required=True)


@command("query-index", _query)
def query_index(spark: SparkSession, a: argparse.Namespace) -> None:
    sketches, posts, kind = I.load_index(spark, a.index)
    key, _, value = a.columns.partition(":")
    rows = tables.pair_of(tables.scan(spark, a.table), f"query/{a.columns}", F.col(key), F.col(value), F.monotonically_increasing_id())
    query = build_sketch(rows, SketchSpec("KMV", a.budget, a.aggregate))
    hits = I.hit_details(I.search(posts, query, kind, a.top_k), query, sketches)
    store.write_hits(I.rerank(hits, a.sort, sketches).orderBy("new_rank"), a.output)


def _synthetic(p: argparse.ArgumentParser) -> None:
    p.add_argument("--source", choices=["SBN", "CDU", "MNL"], default="SBN")
    p.add_argument("--rows", type=int, default=10_000)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--output", required=True)


@command("synthetic", _synthetic)
def make_synthetic(spark: SparkSession, a: argparse.Namespace) -> None:
    """Columns with known mutual information."""
    made = {
        "SBN": lambda: synthetic.bivariate_normal(spark, 0.7, a.rows, seed=a.seed),
        "CDU": lambda: synthetic.discrete_uniform(spark, 20, a.rows, seed=a.seed),
        "MNL": lambda: synthetic.multinomial(spark, 64, 0.3, 0.5, a.rows, seed=a.seed),
    }
    made[a.source]().write.mode("overwrite").parquet(a.output)


@command("scalability", lambda p: p.add_argument("--output", required=True))
def scalability(spark: SparkSession, a: argparse.Namespace) -> None:
    store.write_csv(jobs.information_scalability(spark), a.output)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sketchloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (run, options) in COMMANDS.items():
        options(sub.add_parser(name, help=run.__doc__))
    args = parser.parse_args(argv)
    COMMANDS[args.command][0](tuned(spark or SparkSession.builder.appName("sketchloom").getOrCreate()), args)


if __name__ == "__main__":
    main()
