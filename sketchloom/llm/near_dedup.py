"""Near-duplicate documents by SimHash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.hamming_index import near_groups
from sketchloom.llm.shared import text_key, without_rows, written
from sketchloom.llm.simhash import with_fingerprints


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp (signed long) and component_id.

    Texts are fingerprinted once, into a narrow table; see ``fingerprints`` and ``near_groups``. A null or
    empty text has fingerprint 0 and is linked like any other; a very long text is read in parts. Repeated rows
    are rows of one group, an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    return near_groups(written(with_fingerprints(docs, id_col, text_col), "simhash-prints"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; all columns kept.

    Rows without id stay, as do repeated rows with the id that stays, and texts of an id that are near to none.
    """
    prints = written(with_fingerprints(docs, id_col, text_col, text_key(F.col(text_col))), "simhash-prints")
    gone = near_groups(prints).filter("doc_id <> component_id").select("doc_id", "key")
    return without_rows(docs, id_col, text_col, gone)
