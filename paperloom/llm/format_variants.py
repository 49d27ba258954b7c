"""Problem 1: duplicates hidden by formatting differences.

Canonical records are range-partitioned by (key, id), sorted (Spark's external
sort) and scanned: neighbours with an equal full key form a run. A key may hold
any share of the rows, since its run is cut wherever a partition ends; the pieces
are joined again through at most two marker rows per partition.

Nulls count as blank, an empty table gives an empty result, rows delivered twice
(equal id) count once, further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alike, materialize, table

_SCAN = "kind string, key binary, a string, b string, n long"


def alike_json(col: Column) -> Column:
    """As :func:`alike`; a JSON object counts as the set of its name/value pairs, and an object
    within it too."""
    pairs = F.from_json(col, "map<string,string>")
    nested = lambda v: F.when(F.ltrim(v).rlike("^[{\\[]"), F.coalesce(F.to_json(F.try_parse_json(v)), v)).otherwise(v)  # noqa: E731  (sorted by name)
    one = F.transform(F.map_entries(pairs), lambda e: F.concat(alike(e["key"]), F.lit("="), alike(nested(e["value"]))))
    whole = F.concat(F.lit("{"), F.array_join(F.array_sort(one), "&"))
    return F.when(F.ltrim(col).startswith("{") & pairs.isNotNull(), whole).otherwise(alike(col))


def canonical(df: DataFrame, id_col: str, exact: list[str], spelled: list[str], json: list[str]) -> DataFrame:
    """``key``: the full canonical key in one string; ``id``. Columns compared as they are come
    with their length, so that no value can look like two."""
    whole = [F.coalesce(F.col(c), F.lit("")) for c in exact]
    parts = [F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in whole]
    parts += [alike_json(F.col(c)) if c in json else alike(F.col(c)) for c in spelled]
    return df.select(F.concat_ws("\x1f", *parts).alias("key"), F.col(id_col).alias("id")).where("id is not null")


def _scan(members: bool):
    """Scan one sorted partition. members: a row for each further member of a run,
    else a row for each run with its number of different ids."""
    import hashlib

    def sha(key: str) -> bytes:
        return hashlib.sha256(key.encode("utf-8", "surrogatepass")).digest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_names = ["kind", "key", "a", "b", "n"]
        types = [pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64()]

        def batch(kind, key, a, b, n):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((kind, key, a, b, n), types)], out_names)

        last_key = last_id = first_id = None
        n = runs = 0  # ids in the open run; runs closed or open
        opening: tuple | None = None  # key, first id of the partition's first run
        for rb in batches:
            if not rb.num_rows:
                continue
            k, ids = rb.column(0), rb.column(1)
            m = rb.num_rows
            same_key, same_id = np.zeros(m, bool), np.zeros(m, bool)
            same_key[1:] = pc.equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
            same_id[1:] = pc.equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
            same_key[0] = last_key is not None and k[0].as_py() == last_key
            same_id[0] = last_id is not None and ids[0].as_py() == last_id
            fresh = ~(same_key & same_id)
            start = ~same_key
            at = np.maximum.accumulate(np.where(start, np.arange(m), -1))
            run = runs + np.cumsum(start)
            if opening is None:
                opening = (sha(k[0].as_py()), ids[0].as_py())
            starts = np.flatnonzero(start)
            if members:
                pick = np.flatnonzero(fresh & same_key & (run > 1))
                if len(pick):
                    heads = at[pick]
                    names = ids.take(pa.array(np.maximum(heads, 0))).to_pylist()
                    if heads[0] < 0:
                        names = [first_id if h < 0 else x for h, x in zip(heads, names)]
                    yield batch(["pair"] * len(pick), [None] * len(pick), names, ids.take(pa.array(pick)).to_pylist(), [None] * len(pick))
                early = np.flatnonzero(fresh & (run == 1))
                if len(early):
                    yield batch(["first"] * len(early), [opening[0]] * len(early), [None] * len(early), ids.take(pa.array(early)).to_pylist(), [None] * len(early))
            else:
                total = np.concatenate([[0], np.cumsum(fresh)])
                bounds = [*starts, m]
                done_first, done_n = [], []
                if len(starts):
                    if runs > 1:  # closes a run that isn't the partition's first
                        done_first.append(first_id)
                        done_n.append(n + int(total[starts[0]]))
                    elif runs == 1:
                        yield batch(["edge"], [opening[0]], [opening[1]], [None], [n + int(total[starts[0]])])
                    for s, e in zip(bounds[:-2], bounds[1:-1]):
                        c = int(total[e] - total[s])
                        if runs == 0 and s == 0:
                            yield batch(["edge"], [opening[0]], [opening[1]], [None], [c])
                        else:
                            done_first.append(ids[int(s)].as_py())
                            done_n.append(c)
                    n = int(total[m] - total[starts[-1]])
                else:
                    n += int(total[m])
                if done_first:
                    yield batch(["run"] * len(done_n), [None] * len(done_n), done_first, [None] * len(done_n), done_n)
            if len(starts):
                first_id = ids[int(starts[-1])].as_py()
            runs += len(starts)
            last_key, last_id = k[m - 1].as_py(), ids[m - 1].as_py()
        if opening is not None:
            if members:
                yield batch(["mark", "mark"], [opening[0], sha(last_key)], [opening[1], first_id], [None] * 2, [None] * 2)
            else:
                yield batch(["edge"], [sha(last_key)], [first_id], [None], [n])

    return scan


def _scanned(keyed: DataFrame, members: bool) -> DataFrame:
    ordered = keyed.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    return materialize(ordered.mapInArrow(_scan(members), _SCAN))


def copy_pairs(keyed: DataFrame) -> DataFrame:
    """(a, b): a the smallest id of each group of two or more, b each other id."""
    rows = _scanned(keyed, True)
    first_ids = rows.where("kind = 'mark'").groupBy("key").agg(F.min("a").alias("least"))
    # At most two marks per partition: its size is bounded by the number of partitions.
    early = rows.where("kind = 'first'").join(F.broadcast(first_ids), "key").where("b <> least")
    return rows.where("kind = 'pair'").select("a", "b").unionByName(early.select(F.col("least").alias("a"), "b"))


def collapsed(keyed: DataFrame) -> DataFrame:
    """(id, copies): one representative of each group and its exact number of ids."""
    rows = _scanned(keyed, False)
    edges = rows.where("kind = 'edge'").groupBy("key").agg(F.min("a").alias("id"), F.sum("n").alias("copies"))
    return rows.where("kind = 'run'").select(F.col("a").alias("id"), F.col("n").alias("copies")).unionByName(edges.select("id", "copies"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(table(spark, sf_dir, "candidates"), "candidate_id", ["source_dataset"], ["chunk_id", "label_text", "evidence_span"], ["label_text"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = copy_pairs(_candidates(spark, sf_dir))
    return pairs.select(F.col("a").alias("candidate_id_a"), F.col("b").alias("candidate_id_b"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One representative of each group with the number of copies it had."""
    return collapsed(_candidates(spark, sf_dir)).select(F.col("id").alias("candidate_id"), "copies")


QUERIES = {"p1_found": p1_found, "p1_records": p1_records}
_ALIKE = r"regexp_replace(upper(coalesce({}, '')), '[^\p{{L}}\p{{N}}]', '', 'g')"
_PAIR = r"regexp_replace(upper({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_PAIRS = f"""case when starts_with(ltrim(label_text), '{{' ) and json_valid(label_text) then '{{' || array_to_string(list_sort(list_transform(json_keys(label_text),
lambda x: {_PAIR.format('x')} || '=' || coalesce({_PAIR.format("json_extract_string(label_text, '$.\"' || x || '\"')")}, ''))), '&') else {_ALIKE.format('label_text')} end"""
_GROUPS = f"""with k as (select distinct candidate_id, coalesce(source_dataset, '') as ds, {_ALIKE.format('chunk_id')} as ck, {_PAIRS} as lab, {_ALIKE.format('evidence_span')} as ev
  from candidates where candidate_id is not null),
g as (select *, min(candidate_id) over (partition by ds, ck, lab, ev) as least, count(*) over (partition by ds, ck, lab, ev) as n from k)"""
SQL: dict[str, str] = {
    "p1_found": _GROUPS + " select least as candidate_id_a, candidate_id as candidate_id_b from g where candidate_id <> least",
    "p1_records": _GROUPS + " select least as candidate_id, n as copies from g where candidate_id = least",
}
