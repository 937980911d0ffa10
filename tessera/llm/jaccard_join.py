"""Jaccard self-join of documents on word n-grams, by chosen paths.

A set's tokens are sampled by a hash shared by all sets: each with probability 1 / (t |x|), t the
threshold. A sampled token is a child of the set's node; sampling goes on below it with another
hash, ``depth`` levels down, which makes a tree of token paths. Similar sets follow shared paths
(each shared child is a branch of a surviving process), others part. Sets that end in the same
leaf meet there: small leaves are compared as they are, larger ones in blocks of rows against
blocks of rows, and of leaves with the same members one. Runs with fresh hashes are repeated until
a pair at the threshold is found with the target probability.

Leaves compare bottom-k sketches (whole sets, if they are small) and yield candidate groups; each
group's whole sets are then compared exactly once, by blocks of an incidence matrix. Copies of a
set are joined before all this and only counted, and no pair of rows is ever emitted: tasks return
links per document and one edge per document and group.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import keyed, materialize, partitions, scratch_path, table, trimmed
from .components import connected_components
from .files import open_file, write_file

GRAM = 5
THRESHOLD = 0.8
DEPTH = 4
RECALL = 0.999
SKETCH = 128
#: Sets of a group, and members of a leaf, that meet in one task; larger ones are compared block by
#: block.
BLOCK = 2048
#: Partitions of pairs of blocks, at most: a task takes one pair after the other.
MOST_TASKS = 1 << 15


def survival(threshold: float, depth: int) -> float:
    """Least chance that a pair at the threshold shares a path of ``depth`` tokens.

    Children shared by x and y are about Poisson with mean |x and y| / (t max(|x|, |y|)), which is
    least where one set contains the other: 1, as no set is larger than both together. Equally
    large sets have 2 / (1 + t).
    """
    mean = 1.0
    dead = 0.0
    for _ in range(depth):
        dead = math.exp(mean * (dead - 1))
    return 1 - dead


def runs_for(threshold: float = THRESHOLD, depth: int = DEPTH, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth)))


def shingles(text: str | None, gram: int = GRAM) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``gram`` lower-cased words.

    Fewer words make one run of all of them; no word makes the empty set.
    """
    codes = R.word_codes((text or "").lower().encode())
    return np.unique(R.gram_hashes(codes, min(gram, len(codes)))) if len(codes) else codes


def leaves(tokens: np.ndarray, threshold: float, depth: int, runs: int) -> list[int]:
    """The hashes of the set's paths of ``depth`` chosen tokens, over all runs."""
    share = min(1.0, 1 / (threshold * len(tokens)))
    limit = np.uint64(min(share * 2.0**64, 2.0**64 - 1025))
    nodes = R.mix(np.arange(1, runs + 1, dtype=R.U64))
    for _ in range(depth):
        if not len(nodes):
            break
        found = []
        rows = max(1, (1 << 18) // len(tokens))
        for lo in range(0, len(nodes), rows):  # bounded memory for very long texts
            drawn = tokens[None, :] * (nodes[lo : lo + rows, None] | R.U64(1))
            node, token = np.nonzero(drawn < limit)
            found.append(R.mix(nodes[lo + node] * R.U64(R.BASE) ^ tokens[token]))
        nodes = np.unique(np.concatenate(found))
    return nodes.view(np.int64).tolist()


def _signatures(gram: int, threshold: float, depth: int, runs: int):
    def run(batches):
        for pdf in batches:
            out = []
            for rid, text in pdf[["rid", "text"]].itertuples(index=False, name=None):
                tokens = shingles(text, gram)
                if not len(tokens):
                    out.append((rid, None, 0, None, None))
                    continue
                key = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                low = np.sort(R.mix(tokens ^ R.U64(0x5BF03635)))[:SKETCH]
                low = np.unique((low >> R.U64(32)).astype(np.uint32))
                out.append((rid, key, len(tokens), low.tobytes(), leaves(tokens, threshold, depth, runs)))
            yield pd.DataFrame(out, columns=["rid", "key", "size", "sketch", "leaves"])

    return run


def _incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column of each token that at least two sets share, and the number of columns."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    return rows[keep], number[column[keep]], int(shared.sum())


def shared_counts(sets: list[np.ndarray], block: int = 256, columns: int = 1024, upto: int | None = None):
    """For row blocks lo:hi of the sets (the first ``upto``), the sizes of their intersections with all sets."""
    rows, cols, width = _incidence(sets)
    order = np.lexsort((rows, cols))
    rows, cols = rows[order], cols[order]
    upto = len(sets) if upto is None else upto
    for lo in range(0, upto, block):
        hi = min(lo + block, upto)
        out = np.zeros((hi - lo, len(sets)), np.float32)
        for a in range(0, width, columns):
            i, j = np.searchsorted(cols, a), np.searchsorted(cols, a + columns)
            part = np.zeros((len(sets), columns), np.float32)
            part[rows[i:j], cols[i:j] - a] = 1
            mine = part[lo:hi]
            used = mine.any(0)
            if used.any():
                out += mine[:, used] @ part[:, used].T
        yield lo, hi, out


class Components:
    """Components over 0..n-1, each labelled by its smallest member, from rows of a link matrix."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, lo: int, alike: np.ndarray) -> None:
        """Rows lo.. of the symmetric matrix: each row's members are one component."""
        for i in np.flatnonzero(alike.any(1)):
            mine = np.append(self.label[alike[i]], self.label[lo + i])
            least = mine.min()
            if least != mine.max():
                self.label[np.isin(self.label, mine)] = least


def least_shared(a: np.ndarray, b: np.ndarray, threshold: float, sketch: int = SKETCH) -> np.ndarray:
    """Elements that the sketches of sets of a and b elements share if the sets are alike.

    Alike sets share t (a + b) / (1 + t) elements. Sets no larger than their sketch are there
    whole: exact, but for two elements that may fall together in 32 bits. Else the larger set's
    smallest hashes are the sample, from which six standard deviations are taken off.
    """
    most = np.maximum(a, b)
    shared = threshold * (a + b) / (1 + threshold)
    share = np.minimum(shared / most, 1.0)
    sampled = sketch * share - 6 * np.sqrt(sketch * share * (1 - share))
    return np.where(most <= sketch, shared - 2, sampled)


def _alike(sketches: list[np.ndarray], size: np.ndarray, threshold: float) -> np.ndarray:
    """For each member of a leaf the least member of its component of agreeing sketches.

    No pair at the threshold is lost, but for luck beyond six standard deviations; the exact
    comparison decides later on those that only look alike.
    """
    size = size.astype(float)
    if len(sketches) == 2:
        shared = len(np.intersect1d(*sketches, assume_unique=True))
        return np.array([0, int(shared < least_shared(size[0], size[1], threshold) or size.min() < threshold * size.max() - 1e-6)])
    parts = Components(len(sketches))
    for lo, hi, shared in shared_counts(sketches):
        a, b = size[lo:hi, None], size[None, :]
        alike = (shared >= least_shared(a, b, threshold)) & (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-6)
        alike[np.arange(hi - lo), np.arange(lo, hi)] = False
        parts.add(lo, alike)
    return parts.label


def _leaf_edges(batches, threshold: float):
    """Rows sorted by (leaf, lo, hi, rid): for each task's members (member, least of its component).

    Small groups are many: they are cut from whole batches, and only one group is held over.
    """
    held = None
    for pdf in itertools.chain(batches, [None]):
        if pdf is None:
            rows, last = held, True
        else:
            rows, last = pdf if held is None else pd.concat([held, pdf]), False
        if rows is None or not len(rows):
            continue
        leaf, lo, hi = (rows[c].to_numpy() for c in ("leaf", "lo", "hi"))
        cuts = np.flatnonzero((leaf[1:] != leaf[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        ends = [*cuts.tolist(), len(rows)] if last else cuts.tolist()
        rid, size = rows["rid"].to_numpy(), rows["size"].to_numpy()
        sketch = rows["sketch"].to_numpy()
        a, b, at = [], [], 0
        for end in ends:
            label = _alike([np.frombuffer(s, np.uint32) for s in sketch[at:end]], size[at:end], threshold)
            other = np.flatnonzero(label != np.arange(end - at))
            a.append(rid[at + other])
            b.append(rid[at + label[other]])
            at = end
        held = rows.iloc[at:]
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()


def _linked(rid: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], threshold: float, first: int | None = None) -> pd.DataFrame:
    """Links and edges between all rows; with ``first``, between that many rows and the others only."""
    size = np.array([len(s) for s in sets])
    links = np.zeros(len(rid), np.int64)
    parts = Components(len(rid))
    for lo, hi, shared in shared_counts(sets, upto=first):
        # |x and y| / |x or y| >= t, in whole numbers but for one product
        union = size[lo:hi, None] + size[None, :] - shared
        alike = shared >= threshold * union - 1e-6
        if first is None:
            alike[np.arange(hi - lo), np.arange(lo, hi)] = False
        else:
            alike[:, :first] = False
            links += copies[lo:hi] @ alike
        links[lo:hi] += alike @ copies
        parts.add(lo, alike)
    return pd.DataFrame({"rid": rid, "links": links, "root": rid[parts.label]})


def _exact(pdf: pd.DataFrame, gram: int, threshold: float) -> pd.DataFrame:
    """Links and edges within a group that one task holds."""
    pdf = pdf.sort_values("rid")
    return _linked(pdf["rid"].to_numpy(), pdf["copies"].to_numpy(), [shingles(t, gram) for t in pdf["text"]], threshold)


def _write_block(pdf: pd.DataFrame, folder: str, gram: int) -> pd.DataFrame:
    """The sets of one block of a large group, as a file."""
    pdf = pdf.sort_values("rid")
    sets = [shingles(t, gram) for t in pdf["text"]]
    out = io.BytesIO()
    np.savez(out, rid=pdf["rid"].to_numpy(), copies=pdf["copies"].to_numpy(), size=np.array([len(s) for s in sets]), tokens=np.concatenate(sets))
    path = f"{folder}/{uuid.uuid4().hex}.sets"  # another attempt of this task writes another file
    write_file(path, [out.getvalue()])
    return pd.DataFrame({"grp": pdf["grp"].iloc[:1], "own": pdf["own"].iloc[:1], "path": [path]})


def _read_block(path: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    with open_file(path) as f, np.load(io.BytesIO(f.read())) as x:
        return x["rid"], x["copies"], np.split(x["tokens"], np.cumsum(x["size"])[:-1])


def _compare_blocks(batches, threshold: float):
    """Links and edges within the block of ``a``, or between those of ``a`` and ``b``."""
    for pdf in batches:
        for a, b in pdf[["a", "b"]].itertuples(index=False, name=None):
            rid, copies, sets = _read_block(a)
            if a == b:
                yield _linked(rid, copies, sets, threshold)
            else:
                other = _read_block(b)
                yield _linked(np.concatenate([rid, other[0]]), np.concatenate([copies, other[1]]), sets + other[2], threshold, len(rid))


def _compared(close: DataFrame, sets: DataFrame, rows: DataFrame, threshold: float, gram: int, block: int) -> DataFrame:
    """``rid, links, root`` from the exact comparison of all sets of each group of ``close(rid, grp)``.

    A group of up to ``block`` sets is one task. The sets of a larger one are written once, as files
    of a block each; tasks read two files and compare them, so the comparisons grow with the square
    of the group, but neither the texts that are shuffled nor the sets that are made.
    """
    sizes = materialize(close.groupBy(F.col("grp").alias("g")).agg(F.count(F.lit(1)).alias("members")), "jaccard-sizes")
    members = close.join(sizes, F.col("grp") == F.col("g")).drop("g").join(sets.select("rep", "copies"), F.col("rid") == F.col("rep")).drop("rep")
    texts = rows.select(F.col("rid").alias("r"), "text")
    whole = members.join(texts, F.col("rid") == F.col("r")).select("rid", "text", "copies", "grp", "members")
    schema = "rid long, links long, root long"
    exact = whole.where(F.col("members") <= block).drop("members").groupBy("grp").applyInPandas(lambda p: _exact(p, gram, threshold), schema)
    if sizes.where(F.col("members") > block).isEmpty():
        return exact
    folder = scratch_path(rows.sparkSession, "jaccard-blocks")
    parted = whole.where(F.col("members") > block).withColumn("own", F.pmod(F.xxhash64("rid"), F.ceil(F.col("members") / block)).cast("int"))
    files = parted.groupBy("grp", "own").applyInPandas(lambda p: _write_block(p, folder, gram), "grp long, own int, path string")
    files = materialize(files, "jaccard-block-files")
    pairs = files.select("grp", F.col("own").alias("i"), F.col("path").alias("a")).join(files.select("grp", F.col("own").alias("j"), F.col("path").alias("b")), "grp").where("i <= j")
    dealt = pairs.select("a", "b").repartition(max(partitions(rows.sparkSession), min(MOST_TASKS, pairs.count())))
    return exact.unionAll(dealt.mapInPandas(trimmed(lambda b: _compare_blocks(b, threshold)), schema))


def _in_blocks(members: DataFrame, block: int) -> DataFrame:
    """``members(rid, leaf)`` of leaves with two or more, with the keys of the tasks that compare them.

    A leaf of up to ``block`` rows is one task. A larger one is cut into blocks, and each row
    goes to the pairs of blocks that hold its own: every two rows meet in one task. Of leaves with
    the same members one is enough (they are told apart by 128 bits of hashes).
    """
    sizes = members.groupBy(F.col("leaf").alias("g")).agg(
        F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y")
    )
    sizes = sizes.where("members > 1").groupBy("members", "x", "y").agg(F.min("g").alias("g"))
    rows = members.join(sizes.select("g", "members"), F.col("leaf") == F.col("g")).drop("g")
    count = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("rid"), count).cast("int")
    rows = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.withColumns({"lo": F.least("own", "with"), "hi": F.greatest("own", "with")}).drop("members", "own", "with")


def _candidates(signed: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """``id, root``: the components of what looks alike in some leaf."""
    own = signed.select("rid", "leaves").join(sets.select("rep"), F.col("rid") == F.col("rep"), "left_semi")
    met = _in_blocks(own.select("rid", F.explode("leaves").alias("leaf")), block)
    met = met.join(signed.select(F.col("rid").alias("r"), "size", "sketch"), F.col("rid") == F.col("r")).drop("r")
    dealt = met.repartition(partitions(signed.sparkSession), "leaf", "lo", "hi").sortWithinPartitions("leaf", "lo", "hi", "rid")
    edges = dealt.select("leaf", "lo", "hi", "rid", "size", "sketch").mapInPandas(trimmed(lambda b: _leaf_edges(b, threshold)), "a long, b long")
    return connected_components(edges, "jaccard-candidates")


def jaccard_groups(rows: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``rid, root, links`` for each row of ``rows(rid, text)``; rid must be unique."""
    runs = runs_for(threshold, depth, recall)
    signed = rows.select("rid", "text").mapInPandas(trimmed(_signatures(gram, threshold, depth, runs)), "rid long, key binary, size long, sketch binary, leaves array<long>")
    signed = materialize(signed, "jaccard-signatures")
    sets = signed.where("key is not null").groupBy("key").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies"))
    sets = materialize(sets, "jaccard-sets")

    groups = _candidates(signed, sets, threshold, block)
    close = groups.select(F.col("id").alias("rid"), F.col("root").alias("grp"))
    exact = materialize(_compared(close, sets, rows, threshold, gram, block), "jaccard-links")
    links = exact.groupBy("rid").agg(F.sum("links").alias("linked")).withColumnRenamed("rid", "l")
    roots = connected_components(exact.select(F.col("rid").alias("a"), F.col("root").alias("b")), "jaccard-classes")

    known = sets.join(links, F.col("rep") == F.col("l"), "left").join(roots, F.col("rep") == F.col("id"), "left")
    known = known.select(F.col("key").alias("k"), F.coalesce("root", "rep").alias("root"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = signed.select("rid", "key").join(materialize(known, "jaccard-known"), F.col("key") == F.col("k"), "left")
    return out.select("rid", F.coalesce("root", "rid").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``doc_id, class_id, n_links``: one row for each row of ``docs``.

    Two documents are linked if the Jaccard similarity of their n-gram sets is at least
    ``threshold``; a class is a connected component of links, named by its earliest document (its
    doc_id, or its row number where ids are null or repeated); ``n_links`` counts the documents
    that a document is linked to, copies included.

    * null and empty texts, or white space alone, have no n-grams and link to nothing, not even to
      each other. Under ``gram`` words the whole text is the one n-gram.
    * repeated rows are documents of their own, linked as copies; null doc_ids too.
    * empty table: no rows. Other columns are ignored. Very long texts are compared whole: their
      paths and incidence are made in slices.
    """
    rows = keyed(docs)
    found = jaccard_groups(rows, threshold, gram, depth, recall, block)
    return rows.select(F.col("rid").alias("r"), "doc_id").join(found, F.col("r") == F.col("rid")).select(
        "doc_id", F.col("root").alias("class_id"), F.col("links").alias("n_links")
    )


def keep_one_each(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that are the earliest of their class, all columns as they are.

    Rows without words (null or empty texts) are alone in their class and stay; of equal rows one
    stays; null doc_ids come last; an empty table stays empty. See ``jaccard_join``.
    """
    rows = keyed(docs, whole=True)
    found = jaccard_groups(rows.select("rid", "text"), threshold, gram, depth, recall)
    first = found.where("root = rid").select(F.col("rid").alias("r"))
    return rows.join(first, F.col("rid") == F.col("r"), "left_semi").select("row.*")


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, i, i + 4) END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0) AS s),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id WHERE s.n >= 0.8 * (x.n + y.n - s.n) - 1e-9),
reach(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON r.id = l.a WHERE r.root < l.b)
SELECT d.doc_id, least(d.doc_id, c.class_id) AS class_id, coalesce(k.n, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN (SELECT id, min(root) AS class_id FROM reach GROUP BY id) c ON d.doc_id = c.id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON d.doc_id = k.a
"""
