"""Problem 2: how often every distinct term occurs, in how many records, and whether it is too rare or too common.

Method: heavy-light aggregation. Terms that hold more than a fixed fraction of a sample are heavy; at most
1/fraction of them can exist, so their list is broadcast. Each task counts them in exact local counter arrays and
ships one row per heavy term. Only the remaining terms, already added up per batch, are shuffled term by term. The
two tables of counts are united in the final sum. Detection decides only which way a term is counted, never its counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A term is heavy if it makes up this fraction of the sampled entries or more: never more than 2,000 terms.
HEAVY_FRACTION = 1 / 2000
#: About this share of the rows is looked at to detect heavy terms.
SAMPLE_FRACTION = 0.02
COUNTS = "field string, term string, occurrences long, records long"


def heavy_terms(df: DataFrame, field: str, fraction: float = HEAVY_FRACTION, sample: float = SAMPLE_FRACTION) -> list[str]:
    """Lower-cased terms that are heavy in a Bernoulli sample of the rows; at most 1/fraction terms by definition."""
    entries = df.select(field).sample(fraction=sample, seed=7).select(F.explode(field).alias("term")).where("term is not null").select(F.lower("term").alias("term"))
    counted = entries.groupBy("term").count()
    total = counted.agg(F.sum("count")).first()[0] or 0
    return sorted(r.term for r in counted.where(F.col("count") >= max(2.0, total * fraction)).collect())


def _counter(fields: list[str], heavy: dict[str, list[str]]):
    """The function that counts one partition: heavy terms in arrays, light ones per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {f: pa.array(heavy[f], pa.string()) for f in fields}
        occurrences = {f: np.zeros(len(heavy[f]), np.int64) for f in fields}
        records = {f: np.zeros(len(heavy[f]), np.int64) for f in fields}
        out_schema = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
        pack = lambda f, t, o, r: pa.RecordBatch.from_arrays([pa.array([f] * len(t), pa.string()), t, pa.array(o, pa.int64()), pa.array(r, pa.int64())], schema=out_schema)
        for batch in batches:
            for f in fields:
                column = batch.column(f)
                flat, row = pc.list_flatten(column), pc.list_parent_indices(column)
                kept = pc.is_valid(flat)
                flat, row = pc.utf8_lower(pc.cast(flat.filter(kept), pa.string())), np.asarray(row.filter(kept), dtype=np.int64)
                if not len(flat):
                    continue
                coded = flat.dictionary_encode()
                code, size = np.asarray(coded.indices, dtype=np.int64), len(coded.dictionary)
                occ = np.bincount(code, minlength=size)
                docs = np.bincount(np.unique(row * size + code) % size, minlength=size)
                where = pc.index_in(coded.dictionary, lists[f]).to_numpy(zero_copy_only=False) if len(lists[f]) else np.full(size, np.nan)
                is_heavy = ~np.isnan(where.astype(float))
                at = where[is_heavy].astype(np.int64)
                occurrences[f][at] += occ[is_heavy]
                records[f][at] += docs[is_heavy]
                light = np.flatnonzero(~is_heavy)
                if len(light):
                    yield pack(f, coded.dictionary.take(pa.array(light)), occ[light], docs[light])
        for f in fields:
            if (seen := np.flatnonzero(occurrences[f])).size:
                yield pack(f, lists[f].take(pa.array(seen)), occurrences[f][seen], records[f][seen])

    return run


def term_counts(df: DataFrame, fields: list[str], id_col: str | None = "ord", sample: float = SAMPLE_FRACTION) -> DataFrame:
    """(field, term, occurrences, records) over all rows, each ``id_col`` counted once; terms are lower-cased.

    Null lists and null entries count nothing, the empty string is a term like any other, an empty table gives no
    rows. Only the named columns are read, so other columns may have any name.
    """
    from loomline.plans.lineage import once_per_key

    picked = df.select(*([id_col] if id_col else []), *fields)
    rows = once_per_key(picked, id_col).select(*fields) if id_col else picked
    heavy = {f: heavy_terms(df, f, sample=sample) for f in fields}
    # One pass over the rows: a task's heavy counters are one row a term, so both count tables unite in the same final sum.
    partial = rows.mapInArrow(_counter(fields, heavy), COUNTS)
    return partial.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, fields: list[str], id_col: str = "ord", base_field: str = "tokens", rare_below: int = 3, common_above: float = 0.05) -> DataFrame:
    """``term_counts`` with ``mark``: 'rare' below ``rare_below`` records, 'common' above that share of the records
    whose ``base_field`` isn't null, else null."""
    counts = term_counts(df, fields, id_col)
    base = df.where(F.col(base_field).isNotNull() & F.col(id_col).isNotNull()).agg(F.count_distinct(id_col)).first()[0]
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(base * common_above), "common")
    return counts.select("field", "term", "occurrences", "records", mark.alias("mark"))


def found(df: DataFrame) -> DataFrame:
    """(field, term, mark) of the terms that are too rare or too common."""
    return marked_terms(df, ["tokens", "stemming"]).where("mark is not null").select("field", "term", "mark")
