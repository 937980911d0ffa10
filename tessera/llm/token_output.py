"""Token-id output: texts become ids, ids become files of independent, checked rANS blocks.

The documents are range-sorted once, as texts; each sorted part is tokenized, counted and written
by its task as one or more files, so ids are never shuffled and never kept outside a file.

File: MAGIC | blocks | table | footer | footer length (u64) | MAGIC. A block is a payload of
``rans``; all blocks of a file share its table, the zlib-packed frequencies of ids 0, 1, … as u32.
The footer is zlib-packed JSON of numbers: offset and length of the table; for each block
(checkpoint) its offset, length, number of ids and crc32 of its ids as little-endian u32; for each
document its row id, doc_id and number of ids. Any run of blocks decodes by itself.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, islice
from operator import attrgetter
from string import punctuation

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .common import keyed, materialize, running_sums, scratch_path, table, trimmed
from .files import open_file, write_file

MAGIC = b"TSRANS03"
END_ID = 2
#: Ids that a file holds, about: they are in a task's memory until the file's table is known.
FILE_IDS = 1 << 22
#: Ids that one reading task decodes at a time.
READ_IDS = 1 << 21
#: Words whose ids a worker keeps: as many again that were kept before are still at hand.
CACHE_WORDS = 250_000
#: Characters of texts that are encoded together: each distinct piece of them is looked up once.
TOGETHER = 1 << 23

# How byte-level BPE cuts texts, and the letters it writes bytes as.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


ID = attrgetter("id")


def byte_letters() -> str:
    """The letter of each byte: printable ones stand for themselves, others follow from U+0100."""
    others = iter(range(256, 512))
    return "".join(chr(b) if b in PRINTABLE else chr(next(others)) for b in range(256))


#: White space that no fast path looks into: in ASCII texts, and in others.
RARE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
RARE_ASCII = "".join(c for c in RARE_SPACE if c.isascii())


#: Before the first word of a text, which has no space: texts with two line feeds are encoded whole.
START = "\n\n"


class WordCoder:
    """Ids of whole texts by byte-level BPE, as the tokenizer itself gives them.

    Such a tokenizer cuts a text into words before it merges anything. A single space between two
    characters that aren't white space always begins a word, and a single line feed there always
    is one. So texts are split there, many at a time and as Arrow columns, and the tokenizer's model
    sees each distinct piece once while it is kept; the ids of the texts are gathered from those of
    their pieces. Texts with any other white space, runs of it or some at an end, or with the
    string of an added token, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        #: A text that holds one of these is cut there first, at the tokenizer's own rules.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        plain = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        self.fast = not self.tokenizer.normalizer and str(self.tokenizer.pre_tokenizer) == plain
        self.merge, self.cut, self.letters = self.tokenizer.model.tokenize, regex.compile(WORDS).findall, byte_letters()
        #: Ids of pieces, in two generations: a full one makes room for the next but is asked before
        #: a piece is encoded again, so frequent pieces stay.
        self.kept, self.before = {}, {}
        self.feed, self.tail = self.whole("\n"), lru_cache(4096)(self.word)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def joined(self, piece: str) -> bytes:
        """The ids of a piece after its space, or with the line feed that it begins with; a text's first has START."""
        if piece[0] != "\n":
            return self.piece(" " + piece)
        return self.piece(piece[len(START) :]) if piece.startswith(START) else self.feed + self.piece(piece[1:])

    def piece(self, text: str) -> bytes:
        """The ids of a piece."""
        if (text[1:] if text[0] == " " else text).isalpha():
            if text.isascii():
                return self.word(text.replace(" ", self.letters[32]))
            return self.word(charmap_decode(text.encode(), "strict", self.letters)[0])
        if text.isascii():
            return b"".join([self.word(charmap_decode(w.encode(), "strict", self.letters)[0]) for w in self.cut(text)])
        return self.whole(text)

    def word(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of words in byte letters, some at a time: the loops are the interpreter's own."""
        out = []
        for lo in range(0, len(words), 1 << 9):
            found = list(map(self.merge, words[lo : lo + (1 << 9)]))
            ends = [0, *accumulate(map(len, found))]
            ids = array("I", map(ID, chain.from_iterable(found))).tobytes()
            out += [ids[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]
        return out

    def made(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that aren't kept; marks behind letters are a word of their own."""
        out: list = [None] * len(pieces)
        space, spelled = self.letters[32], lambda t: charmap_decode(t.encode(), "strict", self.letters)[0]
        at, words, fed, marked = [], [], [], {}
        for i, p in enumerate(pieces):
            if p.isalpha():
                at.append(i)
                words.append(space + p if p.isascii() else spelled(" " + p))
                continue
            body = p.rstrip(punctuation)
            if not (body.isalpha() or (body[:1] == "\n" and body[1:].isalpha())):
                out[i] = self.joined(p)
            elif len(body) < len(p):
                marked.setdefault(body, []).append(i)
            else:
                fed.append(i)
        for i, x in zip(at, self.words(words)):
            out[i] = x
        for i, x in zip(fed, self.words([spelled(pieces[i][1:]) for i in fed])):
            out[i] = self.feed + x
        if marked:
            for (body, places), x in zip(marked.items(), self.ids(list(marked))):
                for i in places:
                    out[i] = x + self.tail(pieces[i][len(body) :])
        return out

    def ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces; those of a piece are kept when it is first met."""
        out = list(map(self.kept.get, pieces))
        lacking = [i for i, x in enumerate(out) if x is None]
        if lacking:
            names = [pieces[i] for i in lacking]
            old = list(map(self.before.get, names))
            made = iter(self.made([p for p, x in zip(names, old) if x is None]))
            found = [next(made) if x is None else x for x in old]
            fresh, room = zip(names, found), CACHE_WORDS - len(self.kept)
            self.kept.update(islice(fresh, room))
            if len(found) > room:
                self.before, self.kept = self.kept, dict(islice(fresh, CACHE_WORDS))
            for i, x in zip(lacking, found):
                out[i] = x
        return out

    def odd(self, text: str) -> bool:
        """Whether a text must be encoded whole."""
        if not self.fast or not text or text[0] in " \n" or text[-1] in " \n" or any(t in text for t in self.added):
            return True
        return "  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(c in text for c in (RARE_ASCII if text.isascii() else RARE_SPACE))

    def encode(self, text: str) -> bytes:
        """The ids as native u32."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out = [self.whole(t) if self.odd(t) else None for t in texts]
        plain = [i for i, x in enumerate(out) if x is None]
        if plain:
            pieces = pc.split_pattern(pa.array([START + texts[i].replace("\n", " \n") for i in plain], pa.large_string()), " ")
            coded = pieces.values.dictionary_encode()
            own = self.ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            found = np.frombuffer(b"".join(own), np.uint32)
            sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
            starts, codes = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
            counts = sizes[codes]
            ends = np.concatenate([[0], np.cumsum(counts)])
            small = np.int32 if max(ends[-1], len(found)) < 1 << 31 else np.int64
            at = np.repeat((starts[codes] - ends[:-1]).astype(small), counts)
            at += np.arange(len(at), dtype=small)
            ids, cuts = found[at], ends[pieces.offsets.to_numpy()]
            for i, lo, hi in zip(plain, cuts[:-1], cuts[1:]):
                out[i] = ids[lo:hi].tobytes()
        return out


@lru_cache(1)
def word_coder(path: str) -> WordCoder:
    """One for a worker: what it keeps serves the worker's next tasks too."""
    return WordCoder(path)


def file_parts(docs: list[tuple], ids: list[bytes]) -> Iterator[bytes]:
    """The pieces of a file of documents (row id, doc_id), their ids (native u32) each."""
    everything = np.frombuffer(b"".join(ids), np.uint32)
    counts = np.bincount(everything)
    coding = rans.Table.of_counts(counts)
    blocks, offset, done = [], len(MAGIC), 0
    yield MAGIC
    for n, payload in rans.encode_blocks(everything, coding):
        blocks.append([offset, len(payload), n, zlib.crc32(everything[done : done + n].astype("<u4").tobytes())])
        done += n
        offset += len(payload)
        yield payload
    frequencies = zlib.compress(coding.freq.astype("<u4").tobytes(), 1)
    yield frequencies
    footer = {
        "table": [offset, len(frequencies)], "blocks": blocks,
        "rids": [d[0] for d in docs], "docs": [d[1] for d in docs], "ids": [len(x) // 4 for x in ids],
    }
    packed = zlib.compress(json.dumps(footer).encode(), 1)
    yield packed
    yield len(packed).to_bytes(8, "little") + MAGIC


FILES = "path string, first_rid long, n_docs long, n_ids long, n_bytes long"


def _write_files(tokenizer: str, folder: str, end_id: int, file_ids: int):
    end = np.uint32(end_id).tobytes()

    def written(docs: list[tuple], ids: list[bytes]) -> pd.DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}.rans"  # another attempt of this task writes another file
        size = write_file(path, file_parts(docs, ids))
        return pd.DataFrame({"path": [path], "first_rid": [docs[0][0]], "n_docs": [len(docs)], "n_ids": [sum(map(len, ids)) // 4], "n_bytes": [size]})

    def encoded(batches):
        """(rid, doc_id, ids) of each row, its texts encoded some at a time."""
        coder, rows, held = word_coder(tokenizer), [], 0

        def some():
            for (rid, doc_id, _), ids in zip(rows, coder.encode_all([r[2] for r in rows])):
                yield int(rid), None if pd.isna(doc_id) else int(doc_id), ids + end

        for pdf in batches:
            for row in pdf[["rid", "doc_id", "text"]].itertuples(index=False, name=None):
                if rows and held + len(row[2]) > TOGETHER:
                    yield from some()
                    rows, held = [], 0
                rows.append(row)
                held += len(row[2])
        yield from some()
        coder.before = {}  # a waiting worker keeps one generation

    def run(batches):
        docs, ids, held = [], [], 0
        for rid, doc_id, own in encoded(batches):
            docs.append((rid, doc_id))
            ids.append(own)
            held += len(own) // 4
            if held >= file_ids:
                yield written(docs, ids)
                docs, ids, held = [], [], 0
        if docs:
            yield written(docs, ids)

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode all texts and write the files; returns their list.

    The list (``path, first_rid, n_docs, n_ids, n_bytes, start``) has a row for each file, from
    tasks that ended well: what a lost or doubled attempt wrote isn't in it. It is a table in the
    shared folder; the driver sees sums of its parts.

    * null text: only the end id. null doc_id comes last; equal doc_ids in order of their texts.
    * empty table: no files. Other columns are ignored.
    """
    files = materialize(keyed(docs).orderBy("rid").mapInPandas(trimmed(_write_files(tokenizer, folder, end_id, file_ids)), FILES), "token-files")
    placed = running_sums(files, ["first_rid"], ["n_ids"], "token-starts")
    return placed.select(*files.columns, F.col("before_n_ids").alias("start"))


def read_footer(f) -> dict:
    size = f.size()
    f.seek(size - 8 - len(MAGIC))
    tail = f.read(8 + len(MAGIC))
    if tail[8:] != MAGIC:
        raise ValueError("not a whole file of token ids")
    length = int.from_bytes(tail[:8], "little")
    f.seek(size - 8 - len(MAGIC) - length)
    return json.loads(zlib.decompress(f.read(length)))


def file_table(f, footer: dict) -> rans.Table:
    offset, length = footer["table"]
    f.seek(offset)
    return rans.Table(np.frombuffer(zlib.decompress(f.read(length)), "<u4"))


def decode_range(f, footer: dict, coding: rans.Table, lo: int, hi: int) -> np.ndarray:
    """The ids [lo, hi) of a file: only the blocks that hold them are read, decoded and checked."""
    ends = np.cumsum([b[2] for b in footer["blocks"]])
    a, b = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi, "left")) + 1
    chosen = footer["blocks"][a:b]
    payloads = []
    for offset, length, n, _ in chosen:
        f.seek(offset)
        payloads.append((n, f.read(length)))
    ids = rans.decode_blocks(payloads, coding)
    for (offset, _, _, crc), x in zip(chosen, ids):
        if zlib.crc32(x.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block at {offset} does not match its checksum")
    base = int(ends[a] - chosen[0][2]) if chosen else 0
    return np.concatenate(ids)[lo - base : hi - base] if ids else np.zeros(0, np.uint32)


def _read_files(batches, digest: bool):
    for pdf in batches:
        for path, start, lo_doc, hi_doc in pdf[["path", "start", "lo_doc", "hi_doc"]].itertuples(index=False, name=None):
            with open_file(path) as f:
                footer = read_footer(f)
                coding = file_table(f, footer)
                sizes = np.array(footer["ids"], np.int64)
                ends = np.cumsum(sizes)
                d, hi_doc = int(lo_doc), min(int(hi_doc), len(sizes))
                while d < hi_doc:  # whole documents, about READ_IDS ids at a time
                    base = int(ends[d] - sizes[d])
                    e = max(d + 1, min(hi_doc, int(np.searchsorted(ends, base + READ_IDS, "right"))))
                    ids = decode_range(f, footer, coding, base, int(ends[e - 1])).astype("<u4")
                    cuts = ends[d:e] - sizes[d:e] - base
                    out = {"doc_id": pd.array(footer["docs"][d:e], "Int64"), "start": int(start) + base + cuts, "n_tokens": sizes[d:e]}
                    own = [ids[a : a + n] for a, n in zip(cuts, sizes[d:e])]
                    out |= {"ids_crc32": [zlib.crc32(x) for x in own]} if digest else {"ids": [x.tobytes() for x in own]}
                    yield pd.DataFrame(out)
                    d = e


def read_tokens(files: DataFrame, docs_a_task: int = 8192, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: from the files, a run of documents to each task.

    ``ids`` are little-endian u32; with ``digest`` their crc32 comes in their place, ``ids_crc32``. Tasks open files by footer and checkpoints; no task needs
    another's state, and a failed one is simply run again.
    """
    spans = files.withColumn("lo_doc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(docs_a_task).cast("long"))))
    spans = spans.withColumn("hi_doc", F.col("lo_doc") + docs_a_task).select("path", "start", "lo_doc", "hi_doc")
    parts = max(1, spans.count())
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary")
    return spans.repartition(parts).mapInPandas(trimmed(lambda b: _read_files(b, digest)), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` and read them back: ``doc_id, start, n_tokens, ids_crc32``."""
    spark: SparkSession = docs.sparkSession
    files = write_tokens(docs, folder or scratch_path(spark, "tokens"), tokenizer or default_tokenizer())
    return read_tokens(files, digest=True)


def op10_token_output(spark, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))
