"""Token counts as additive rollups, maintained by signed deltas.

A ledger is a folder in a store that all machines share.  ``apply`` takes a batch of changes (inserts, deletes, revised
counts) with a batch id, turns it into signed deltas per source, language and tokenizer version, and commits it once:
the deltas are written to a folder named by the batch, which becomes visible by one rename.  A batch whose folder is
there has been committed, so applying it again changes nothing, and a run that dies before the rename leaves nothing
visible.  ``totals`` adds up the committed deltas; since sums are additive, batches may come in any order.  ``fold`` writes
the totals and the names of the batches they hold, again made visible by one rename; from then on totals are that table
and the batches after it, so their cost follows the changes since, not the ledger's age.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import texts, tune

KEYS = ("source", "lang", "tokenizer")
SUMS = ("docs", "tokens", "chars")
ROWS = "doc_id long, source string, lang string, tokenizer string, tokens long, chars long"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file in tiktoken's format."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def counter(ranks: dict[bytes, int] | None, pattern: str):
    """A function from a text to its number of tokens: byte-pair encoding by ``ranks`` of the pieces that ``pattern``
    finds; without ranks, the number of pieces."""
    import regex

    if ranks is None:
        find = regex.compile(pattern).findall
        return lambda text: len(find(text))
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(own.encode_ordinary(text))


def counted(docs: DataFrame, tokenizers: Mapping[str, tuple[str | None, str]]) -> DataFrame:
    """``ROWS`` for each row of ``docs`` (doc_id, text, source, lang; other columns ignored) and each tokenizer version.

    ``tokenizers`` has (vocabulary file's path or None, splitting pattern) by version.  The driver reads the files (a
    vocabulary has a fixed size) and sends them out.  A null text counts as an empty one: no tokens.
    """
    versions = docs.sparkSession.sparkContext.broadcast({name: (path and read_ranks(path), pattern) for name, (path, pattern) in tokenizers.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {name: counter(*where) for name, where in versions.value.items()}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "source", "lang", "text")]
            rows = [(d, s, g, name, f(t), len(t)) for d, s, g, t in zip(*columns, strict=True) for name, f in count.items()]
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _rows_schema, strict=True)], schema=_rows_schema)

    tune(docs.sparkSession)
    return texts(docs, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, ROWS)


_rows_schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("tokenizer", pa.string()), ("tokens", pa.int64()), ("chars", pa.int64())])


def deltas(inserted: DataFrame | None = None, deleted: DataFrame | None = None, revised: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Signed sums by KEYS of frames with ROWS: inserted rows count +1, deleted ones -1, of revised ones the old row -1 and
    the new one +1.  Rows are summed before the shuffle, so a hot source costs a row for each task."""
    parts = [(f, sign) for f, sign in ((inserted, 1), (deleted, -1)) if f is not None]
    if revised is not None:
        parts += [(revised[0], -1), (revised[1], 1)]
    if not parts:
        raise ValueError("a batch needs changes")
    every = None
    for frame, sign in parts:
        one = frame.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.col("tokens") * sign).alias("tokens"), (F.col("chars") * sign).alias("chars"))
        every = one if every is None else every.union(one)
    return every.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))


class Ledger:
    """Totals in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        # any string may name a batch
        return f"{self.path}/batches/{hashlib.sha256(batch.encode()).hexdigest()}"

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(self._folder(batch)))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit ``changes`` (from `deltas`) as ``batch``; False, and nothing done, if that batch has been committed."""
        if self.committed(batch):
            return False
        tries = f"{self.path}/tries"
        self._fs.mkdirs(self._path(tries))
        self._fs.mkdirs(self._path(f"{self.path}/batches"))
        staged = f"{tries}/{uuid.uuid4().hex}"
        changes.select(*KEYS, *(F.col(c).cast("long").alias(c) for c in SUMS)).write.parquet(staged)
        if self.committed(batch) or not self._fs.rename(self._path(staged), self._path(self._folder(batch))):
            # another run was faster
            self._fs.delete(self._path(staged), True)
            return False
        # where the other run's folder appeared in between, the rename went into it: as a folder that no reader looks into
        inside = self._path(f"{self._folder(batch)}/{staged.rsplit('/', 1)[1]}")
        if self._fs.exists(inside):
            self._fs.delete(inside, True)
            return False
        return True

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _folded(self) -> tuple[str | None, list[str]]:
        """The folder of the newest fold, and the batches that it doesn't hold."""
        last = next(reversed(self._names("folded")), None)
        if last is None:
            return None, self._names("batches")
        folder = f"{self.path}/folded/{last}"
        held = {r[0] for r in self.spark.read.schema("batch string").json(f"{folder}/names").collect()}
        return folder, [b for b in self._names("batches") if b not in held]

    def fold(self) -> bool:
        """Write the totals of all committed batches as one table; False if there is nothing new, or another run was faster.

        The batches' folders stay, as their names keep them from being applied again; the data of batches that the fold
        before this one held already goes, so a reader of that one is not disturbed.
        """
        before, new = self._folded()
        if not new:
            return False
        every, n = self._names("batches"), len(self._names("folded"))
        staged = f"{self.path}/tries/{uuid.uuid4().hex}"
        self._fs.mkdirs(self._path(f"{self.path}/folded"))
        self._sums(before, new).write.parquet(f"{staged}/sums")
        self.spark.createDataFrame([(b,) for b in every], "batch string").coalesce(1).write.json(f"{staged}/names")
        target = self._path(f"{self.path}/folded/{n:09d}")
        if self._fs.exists(target) or not self._fs.rename(self._path(staged), target) or self._fs.exists(self._path(f"{self.path}/folded/{n:09d}/{staged.rsplit('/', 1)[1]}")):
            self._fs.delete(self._path(staged), True)
            self._fs.delete(self._path(f"{self.path}/folded/{n:09d}/{staged.rsplit('/', 1)[1]}"), True)
            return False
        for b in every:
            if b not in new:
                for s in self._fs.listStatus(self._path(f"{self.path}/batches/{b}")):
                    self._fs.delete(s.getPath(), True)
        return True

    def _sums(self, folded: str | None, batches: list[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, docs long, tokens long, chars long"
        paths = ([f"{folded}/sums"] if folded else []) + [f"{self.path}/batches/{b}" for b in batches]
        # files alone: a folder within a batch's folder is what a lost race left
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where(" OR ".join(f"{c} <> 0" for c in SUMS))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens, chars) over all committed batches; keys whose sums are all 0 go.

        A null source or language is a key of its own.
        """
        return self._sums(*self._folded())
