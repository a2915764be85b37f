"""Ranked lexical search: an inverted index of blocks, searched by Block-Max MaxScore.

Documents are dealt by hash to shards of about ``SHARD_DOCS`` documents and ``SHARD_POSTINGS``
postings.  In a shard, documents are numbered by ascending id; each term has a list of
(document, impact) in compressed blocks of ``BLOCK`` postings, with the last document and the
largest impact of each block beside it, uncompressed, and the largest of the list as its bound.

A query takes its lists in order of bound.  Lists whose bounds together can't beat the worst of
the best ``k`` so far are non-essential: documents that stand only in them are never looked at.
The others are summed over windows of documents; each document found must then beat the limit
with the bounds of its blocks in one non-essential list after the other, and only blocks that
hold a document still in the race are decompressed.  Later documents of a shard have larger
ids, so at equal scores the one found first stays, as the ranking wants.  Each shard hands on
its best ``k`` of each query; the window that merges them limits before it shuffles.

Scores are whole numbers: a term weighs floor(1000 * ln((2N + 2) / (2df + 1))), its impact is
(10^9 * tf) div (1000 * tf + 8 * m) with m = 10 + (90 * n * N) div L.

Null and empty texts have no terms and are never found; queries without a term that occurs find
nothing and have no row.  Repeated documents and repeated queries count each.  Ties rank by
ascending id, null ids last.  Texts are cut into terms by bytes, never cut off.  Columns beside
id and text are ignored, whatever their names.  Empty tables give an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from accessloom.llm.common import stored

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK, WINDOW = 128, 1024
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 21
#: Queries and terms searched together in a task.
QUERIES, QUERY_TERMS = 256, 1 << 16
#: Up to so many bytes of wanted terms travel with the code that reads the texts.
WANTED_BYTES = 8 << 20
#: Bytes of texts cut into terms at once; a longer text is taken alone.
SLICE = 8 << 20

_TERMS = "uid long, id long, n long, terms array<string>, tfs array<long>"
_LISTS = (
    "shard long, term string, n_postings long, bound long, lasts array<int>, tops array<long>, "
    "blocks array<binary>, ids array<long>"
)
_FOUND = "query long, id long, score long"


def _counted(texts: pa.Array, wanted: pa.Array | None) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Terms of each text with repeats; and ends, terms and counts of each text's distinct ones."""
    # taken: lowering a slice in place reads it from the wrong byte
    texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
    split = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    owner, flat = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
    some = pc.greater(pc.binary_length(flat), 0)
    owner, flat = owner[some.to_numpy(zero_copy_only=False)], flat.filter(some)
    n = np.bincount(owner, minlength=len(texts))
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    if wanted is not None:
        keep = pc.is_in(coded.dictionary, value_set=wanted).to_numpy(zero_copy_only=False)[codes]
        owner, codes = owner[keep], codes[keep]
    width = max(len(coded.dictionary), 1)
    both, tf = np.unique(owner * width + codes, return_counts=True)
    owner, codes = both // width, both % width
    return n, np.searchsorted(owner, np.arange(1, len(texts) + 1)), coded.dictionary.take(pa.array(codes)), tf


def document_terms(docs: DataFrame, text: str = "text", number: str = "doc_id", wanted: list[str] | None = None) -> DataFrame:
    """A row per document: uid, id, n (terms with repeats), its distinct terms and their counts.

    With ``wanted`` only those of these terms; ``n`` still counts all.
    """

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = None if wanted is None else pa.array(wanted, pa.large_string())
        for batch in source:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy())
            at = 0
            while at < len(batch):
                before = sizes[at - 1] if at else 0
                until = max(int(np.searchsorted(sizes, before + SLICE, side="right")), at + 1)
                part = batch.slice(at, until - at)
                n, ends, terms, tf = _counted(part.column(2), among)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(offsets, terms.cast(pa.string())),
                    pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64())),
                ], names=["uid", "id", "n", "terms", "tfs"])
                at = until

    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(number).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, _TERMS)


def pack(docs: np.ndarray, impacts: np.ndarray) -> bytes:
    return zlib.compress(np.diff(docs, prepend=0).astype("<u4").tobytes() + impacts.astype("<u4").tobytes(), 1)


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(block), "<u4").astype(np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


def _shard_lists(key: tuple, table: pa.Table) -> pa.Table:
    """The lists of one shard, and a row without a term that holds the ids of its documents."""
    table = table.sort_by([("id", "ascending"), ("uid", "ascending")]).combine_chunks()  # null ids last
    terms, tfs = table["terms"].combine_chunks(), table["tfs"].combine_chunks()
    doc = pc.list_parent_indices(terms).to_numpy().astype(np.int64)
    coded = pc.list_flatten(terms).dictionary_encode()
    code, tf = coded.indices.to_numpy(), pc.list_flatten(tfs).to_numpy()
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * table["m"].to_numpy()[doc])
    order = np.lexsort((doc, code))
    code, doc, impact = code[order], doc[order], impact[order]
    edges = np.searchsorted(code, np.arange(len(coded.dictionary) + 1))
    counts, bounds, lasts, tops, blocks = [], [], [], [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        starts = range(a, b, BLOCK)
        top = np.maximum.reduceat(impact[a:b], np.arange(0, b - a, BLOCK))
        counts.append(b - a)
        bounds.append(int(top.max()))
        tops.append(top.tolist())
        lasts.append([int(doc[min(s + BLOCK, b) - 1]) for s in starts])
        blocks.append([pack(doc[s : min(s + BLOCK, b)], impact[s : min(s + BLOCK, b)]) for s in starts])
    shard, size = int(key[0].as_py()), len(edges)
    return pa.table({
        "shard": pa.array([shard] * size, pa.int64()),
        "term": pa.array([*coded.dictionary.to_pylist(), None], pa.string()),
        "n_postings": pa.array([*counts, None], pa.int64()), "bound": pa.array([*bounds, None], pa.int64()),
        "lasts": pa.array([*lasts, None], pa.list_(pa.int32())), "tops": pa.array([*tops, None], pa.list_(pa.int64())),
        "blocks": pa.array([*blocks, None], pa.list_(pa.binary())),
        "ids": pa.array([None] * (size - 1) + [table["id"].to_pylist()], pa.list_(pa.int64())),
    })


class Index:
    """``lists``: the blocks by shard and term; ``found``: df by term; and the two corpus counts."""

    def __init__(self, lists: DataFrame, found: DataFrame, documents: int, shards: int):
        self.lists, self.found, self.documents, self.shards = lists, found, documents, shards


def build_index(docs: DataFrame, text: str = "text", number: str = "doc_id", wanted: list[str] | None = None) -> Index:
    """The index of all documents, of all terms or of the wanted ones."""
    rows = stored(document_terms(docs, text, number, wanted).where("n > 0"), "document_terms")
    documents, length, postings = rows.agg(
        F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    shards = max(-(-documents // SHARD_DOCS), -(-postings // SHARD_POSTINGS), 1)
    dealt = rows.where(F.size("terms") > 0).select(
        F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"), "uid", "id", "terms", "tfs",
        F.expr(f"10 + (90L * n * {documents}L) div {max(length, 1)}L").alias("m"))
    lists = stored(dealt.groupBy("shard").applyInArrow(_shard_lists, _LISTS), "lists")
    found = lists.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n_postings").alias("df"))
    return Index(lists, found, documents, shards)


class PostingList:
    """A list with its weight; blocks are decompressed when asked for, once."""

    def __init__(self, weight: int, bound: int, lasts, tops, blocks):
        self.weight, self.bound = weight, weight * bound
        self.lasts, self.tops = np.asarray(lasts, np.int64), weight * np.append(np.asarray(tops, np.int64), 0)
        self.blocks, self.known = blocks, {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.known:
            docs, impacts = unpack(self.blocks[i])
            self.known[i] = docs, impacts * self.weight
        return self.known[i]

    def add_window(self, total: np.ndarray, lo: int) -> None:
        hi = lo + len(total)
        for i in range(int(np.searchsorted(self.lasts, lo)), len(self.lasts)):
            docs, scores = self.block(i)
            if docs[0] >= hi:
                break
            a, b = np.searchsorted(docs, (lo, hi))
            total[docs[a:b] - lo] += scores[a:b]
            if self.lasts[i] >= hi - 1:
                break


def best_documents(lists: list[PostingList], size: int, k: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and scores over 0 of the best ``k`` of ``size`` documents, smaller numbers first at ties."""
    lists = sorted(lists, key=lambda x: x.bound)
    below = np.concatenate([[0], np.cumsum([x.bound for x in lists])]).astype(np.int64)
    docs, scores, limit = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for lo in range(0, size, window):
        # documents only in lists[:essential] have at most below[essential]
        essential = int(np.searchsorted(below, limit, side="right")) - 1
        if essential == len(lists):
            break
        total = np.zeros(min(window, size - lo), np.int64)
        for x in lists[essential:]:
            x.add_window(total, lo)
        found = np.flatnonzero(total)
        for i in range(essential - 1, -1, -1):
            if not len(found):
                break
            x = lists[i]
            place = np.searchsorted(x.lasts, found + lo)
            race = total[found] + x.tops[place] + below[i] > limit
            found, place = found[race], place[race]
            for b in np.unique(place[place < len(x.lasts)]).tolist():
                of, (members, add) = found[place == b], x.block(b)
                at = np.minimum(np.searchsorted(members, of + lo), len(members) - 1)
                total[of] += np.where(members[at] == of + lo, add[at], 0)
        found = found[total[found] > limit]
        docs, scores = np.concatenate([docs, found + lo]), np.concatenate([scores, total[found]])
        order = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[order], scores[order]
        if len(docs) == k:
            limit = int(scores[-1])
    return docs, scores


def _searcher(k: int):
    def search(lists: pa.Table, queries: pa.Table) -> pa.Table:
        known, ids = {}, []
        for row in lists.to_pylist():
            if row["term"] is None:
                ids = row["ids"]
            else:
                known[row["term"]] = PostingList(row["weight"], row["bound"], row["lasts"], row["tops"], row["blocks"])
        out = {"query": [], "id": [], "score": []}
        for query, terms in zip(queries["query"].to_pylist(), queries["terms"].to_pylist()):
            docs, scores = best_documents([known[t] for t in terms if t in known], len(ids), k)
            out["query"] += [query] * len(docs)
            out["id"] += [ids[i] for i in docs.tolist()]
            out["score"] += scores.tolist()
        return pa.table(out, schema=pa.schema([(n, pa.int64()) for n in out]))

    return search


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, id, score): the best ``k`` documents with a score over 0 of each query.

    ``queries`` has query (long, unique) and terms (distinct).
    """
    if k < 1:
        raise ValueError("k is at least 1")
    n, terms = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    parts = max(-(-n // QUERIES), -(-terms // QUERY_TERMS), 1)
    queries = queries.select("query", "terms", F.pmod(F.xxhash64("query"), F.lit(parts)).alias("part"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * index.documents + 2)) / (2 * F.col("df") + 1)))
    weights = queries.select("part", F.explode("terms").alias("term")).distinct().join(index.found, "term").select(
        "part", "term", weight.cast("long").alias("weight")).where("weight > 0")
    wanted = index.lists.join(weights, "term").select(
        "shard", "part", "term", "weight", "bound", "lasts", "tops", "blocks", F.lit(None).cast("array<long>").alias("ids"))
    ids = index.lists.where("term IS NULL").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"),
        F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("weight"), "bound", "lasts", "tops", "blocks", "ids")
    asked = queries.select(
        "query", "terms", F.col("part").alias("p"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(index.shards - 1).cast("long"))).alias("s"))
    found = wanted.unionByName(ids).groupBy("shard", "part").cogroup(asked.groupBy("s", "p")).applyInArrow(
        _searcher(k), _FOUND)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def ranked_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", number: str = "doc_id",
    item_text: str = "text", item_number: str = "item_id",
) -> DataFrame:
    """item_id, rank, doc_id, score of each item's best documents.

    Only lists of terms that items have are built, where these terms are few enough to travel.
    """
    asked = stored(document_terms(items, item_text, item_number), "asked")
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    held = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 8), F.lit(0))).first()[0]
    wanted = sorted(r[0] for r in terms.collect()) if held <= WANTED_BYTES else None
    index = build_index(docs, text, number, wanted)
    found = search(index, asked.select(F.col("uid").alias("query"), "terms"), k)
    return found.join(asked.select(F.col("uid").alias("query"), F.col("id").alias("item_id")), "query").select(
        "item_id", "rank", F.col("id").alias("doc_id"), "score")


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_SPLIT} AS t FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
q AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_SPLIT}) AS t FROM benchmark),
qt AS (SELECT q, item_id, unnest(t) AS term FROM q),
p AS (
  SELECT uid, doc_id, n, term, count(*) AS tf
  FROM (SELECT uid, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
scored AS (
  SELECT q, item_id, uid, doc_id, CAST(sum(
    CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM qt JOIN p USING (term) JOIN df USING (term), s GROUP BY ALL),
r AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (
    PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS INT) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
