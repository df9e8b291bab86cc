"""Token ids of whole texts, and their Parquet form: list columns with dictionary or delta encoding, row groups of a
stated size and page indexes, so that ids and metadata can be read apart and by ranges of doc_id."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_text, map_arrow, new_path, read_table, shuffle_partitions

#: Words that a worker remembers with their ids, at most (about 50 bytes each), and bytes of text that are encoded at once.
REMEMBERED, AT_ONCE = 1_000_000, 8 << 20
#: Latin letters (those that lower-case to one letter), and ASCII's marks.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-įı-ſ", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain(t: str) -> bool:
    """Whether a text is words parted by lone spaces and line feeds, without other white space, control characters or special strings."""
    return bool(t) and t.replace("\n", "").isprintable() and t[0] not in " \n" and t[-1] not in " \n" and not any(x in t for x in ("  ", "\n\n", " \n", "\n ", "<|"))


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs of numbers, one run after another."""
    ends = np.cumsum(size)
    at = np.repeat(begin - (ends - size), size)
    at += np.arange(len(at))
    return at


class TokenIds:
    """Ids of texts by the tokenizers library.

    A text of words parted by lone spaces and line feeds is encoded word by word, each distinct word once while it
    is remembered: pre-tokens never span such a boundary, so the ids are those of the whole text. Any other text (other white
    space, runs of it, special strings) goes to the library whole. spaced: whether a word keeps the space before it
    (byte-level vocabularies) or white space is dropped. Remembered words are an Arrow array, looked up by Arrow; when there are
    REMEMBERED of them, the half that was used last stays.
    """

    _made: dict[tuple[str, bool], TokenIds] = {}

    def __init__(self, file: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(file), spaced
        self.words, self.ids, self.at = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)  # ids of word i: from at[i] to at[i + 1]
        self.used, self.turn = np.zeros(0, np.int32), 0
        # the byte-level alphabet: printable Latin-1 stands for itself, other bytes for the characters from 256 on; words are parted by line feeds
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown) if b != 10}
        self.model = self.tokenizer.model

    @classmethod
    def of(cls, file: str, spaced: bool) -> TokenIds:
        """One for a worker, so that its words last from task to task; another vocabulary's takes its place."""
        if (file, spaced) not in cls._made:
            cls._made.clear()
            cls._made[file, spaced] = cls(file, spaced)
        return cls._made[file, spaced]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]

    def _learn(self, new: pa.Array) -> None:
        """Remembers the ids of distinct words. A run of letters goes to the library's model at once, as bytes in its alphabet and without the
        pattern matching before it; other words go the whole way."""
        is_run = pc.match_substring_regex(new, f"^ ?[{LETTERS}]+$")
        letters, rest = new.filter(is_run), new.filter(pc.invert(is_run))
        shown = "\n".join(letters.to_numpy(zero_copy_only=False).tolist())
        shown = (shown if self.spaced else shown.lower()).encode().decode("latin-1").translate(self.alphabet)
        tokenize = self.model.tokenize
        lists = [[t.id for t in tokenize(raw)] for raw in shown.split("\n")] if len(letters) else []
        lists += self._ids(rest.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        self.words = pa.concat_arrays([self.words, letters, rest])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), "<u4", int(size.sum()))])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
        self.used = np.concatenate([self.used, np.full(len(lists), self.turn, np.int32)])

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[: REMEMBERED // 2])
        size = np.diff(self.at)[keep]
        self.ids = self.ids[runs(self.at[keep], size)]
        self.words, self.used, self.at = self.words.take(pa.array(keep)), self.used[keep], np.concatenate([[0], np.cumsum(size)])

    def _known(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words; those that aren't remembered are learnt."""
        found = pc.index_in(words, value_set=self.words)
        if found.null_count:
            self._learn(words.filter(pc.is_null(found)))
            found = pc.index_in(words, value_set=self.words)
        i = found.to_numpy(zero_copy_only=False)
        self.used[i] = self.turn
        return i

    def _word_ids(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one word after another, and how many each has. Both vocabularies part a letter from the marks after it, so
        marks at a word's end are looked up apart."""
        stems = pc.ascii_rtrim(names, characters=MARKS)
        cut = np.flatnonzero(pc.not_equal(pc.binary_length(names), pc.binary_length(stems)).to_numpy(zero_copy_only=False))
        after = stems.take(pa.array(cut))
        is_letter = pc.match_substring_regex(after, f"[{LETTERS}]$").to_numpy(zero_copy_only=False)
        cut, after = cut[is_letter], after.filter(pa.array(is_letter))
        whole = names.take(pa.array(cut)).to_numpy(zero_copy_only=False).tolist()
        marks = pa.array([w[n:] for w, n in zip(whole, pc.utf8_length(after).to_numpy(zero_copy_only=False).tolist(), strict=True)], pa.large_string()).dictionary_encode()
        has_marks = np.zeros(len(names), bool)
        has_marks[cut] = True
        heads = pc.if_else(pa.array(has_marks), stems, names).dictionary_encode()
        # both are found in one go; a mark may be a word too
        both = pa.concat_arrays([heads.dictionary, marks.dictionary]).dictionary_encode()
        number = self._known(both.dictionary)[both.indices.to_numpy(zero_copy_only=False)]
        k = len(heads.dictionary)
        part = np.zeros((len(names), 2), np.int64)
        part[:, 0] = number[:k][heads.indices.to_numpy(zero_copy_only=False)]
        part[cut, 1] = number[k:][marks.indices.to_numpy(zero_copy_only=False)]
        size = self.at[part + 1] - self.at[part]
        size[~has_marks, 1] = 0
        return self.ids[runs(self.at[part].ravel(), size.ravel())], size.sum(axis=1)

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by end_id, one after another, and the places where texts begin (with the total last).

        The texts' distinct words are found by Arrow's dictionary encoding, looked up or learnt once, and their ids gathered by arrays.
        """
        self.turn += 1
        if len(self.words) > REMEMBERED:
            self._forget()
        is_plain = np.array([plain(t) for t in texts], bool)
        cut = [t for t, p in zip(texts, is_plain, strict=True) if p]
        if self.spaced:
            words = pc.split_pattern(pa.array([t.replace("\n", "\x00\n\x00").replace(" ", "\x00 ") for t in cut], pa.large_string()), "\x00")
        else:
            words = pc.ascii_split_whitespace(pa.array(cut, pa.large_string()))
        distinct = words.flatten().dictionary_encode()
        ids, size = self._word_ids(distinct.dictionary) if len(distinct.dictionary) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        # a text that goes whole is one more word, and so is the end id
        first_whole = len(size)
        lists = [*self._ids([t for t, p in zip(texts, is_plain, strict=True) if not p]), [end_id]]
        size = np.concatenate([size, np.fromiter(map(len, lists), np.int64, len(lists))])
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(lists), "<u4")])
        begin = np.cumsum(size) - size
        # the words of each text in turn
        n = np.ones(len(texts), np.int64)
        n[is_plain] = np.diff(words.offsets.to_numpy())
        last = np.cumsum(n + 1) - 1
        seq, of_word = np.empty(int(last[-1]) + 1 if len(texts) else 0, np.int32), np.ones(int(last[-1]) + 1 if len(texts) else 0, bool)
        of_word[last] = of_word[last[~is_plain] - 1] = False
        seq[of_word] = distinct.indices.to_numpy(zero_copy_only=False)
        seq[last[~is_plain] - 1] = first_whole + np.arange(int((~is_plain).sum()))
        seq[last] = len(size) - 1
        run = size[seq]
        ends = np.concatenate([[0], np.cumsum(run)[last]])
        return ids[runs(begin[seq], run)], ends


def grouped(batches: Iterator[pa.RecordBatch], size: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches put together up to some bytes: more texts share their distinct words."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def token_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_token_table(docs: DataFrame, path: str, file: str, end_id: int, row_group_bytes: int = 16 << 20, page_rows: int = 2000, delta: bool = False, partitions: int | None = None) -> None:
    """Writes doc_id, part, n_tokens and ids (list of int) in ascending doc_id order over the files' order.

    Documents are dealt by ranges of doc_id and sorted inside a range; ties (repeated ids) come in the order of their
    texts' hashes. Null text is an empty text: the end id alone. Null doc_id sorts first. delta=False: dictionary
    encoding with fallback to plain; delta=True: delta-packed integers (format version 2). Page indexes are written always.
    """
    n = partitions or shuffle_partitions(docs.sparkSession)
    # the second key parts a doc_id that is repeated very often
    dealt = docs.selectExpr("cast(doc_id as long) doc_id", "text").withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = TokenIds.of(file, False)
        for b in grouped(batches):
            ids, at = enc.encode(as_text(b.column(1)), end_id)
            values, offsets, sizes = pa.array(ids.view("<i4"), pa.int32()), pa.array(at, pa.int32()), np.diff(at).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "n_tokens", "ids"])

    out = map_arrow(dealt, run, "doc_id long, n_tokens int, ids array<int>").select("doc_id", F.spark_partition_id().alias("part"), "n_tokens", "ids")
    out.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows).option("parquet.enable.dictionary", str(not delta).lower()).option("parquet.writer.version", "PARQUET_2_0" if delta else "PARQUET_1_0").parquet(path)


def token_ids(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The table's rows with first <= doc_id <= last; the range is pushed down to row groups and pages. Selecting
    doc_id and n_tokens alone reads no ids."""
    df = spark.read.schema("doc_id long, part int, n_tokens int, ids array<int>").parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    return df if last is None else df.where(F.col("doc_id") <= last)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, all from the files' rows. Null doc_ids come first, as the writer dealt them; repeated
    rows follow one another; an empty table gives no rows.

    A part is a range of doc_id in one task's hands; the sums of parts, as many rows as there are parts, are
    added up in order, and inside a part the rows are in order already.
    """
    table = token_ids(spark, path)
    parts = table.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(values, "<i4")).cast("B")
            at = (offsets * 4).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array([zlib.crc32(raw[i:j]) for i, j in zip(at, at[1:])], pa.int64())], names=["doc_id", "part", "n_tokens", "ids_crc32"])

    # rows of a part are ordered as the writer dealt them
    rows = map_arrow(table.select("doc_id", "part", "ids"), crc, "doc_id long, part int, n_tokens long, ids_crc32 long")
    inner = Window.partitionBy("part").orderBy("doc_id", "at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    return rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(before, "part").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written by write_token_table and read back by token_digests."""
    path = new_path(spark, "tokens")
    write_token_table(read_table(spark, sf_dir, "documents"), path, token_file("word_bpe_49k.json"), 2)
    return token_digests(spark, path)


QUERIES = {"op3_token_output": op3_token_output}
SQL: dict[str, str] = {}
