"""Token counts kept up to date by signed deltas.

Batches of document events (insert, delete, revise) are turned into signed rows
of documents and tokens, against what the ledger says of each document so far.
The rows of a batch are written once; totals by source, language and tokenizer
version are sums of the batches' deltas.  A log of numbered entries says which
batches are committed: an entry's number can be taken once, so a writer that
another one overtook works its deltas out again.  Entries are written beside the
log and renamed into it, so one is there whole or not at all, whatever happens
to its writer.  A batch that is committed already is left alone, so replays
change nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import Files
from .common import delete_path, text_chunks, worker_state
from .token_frames import WordEncoder

GROUP = ("source", "lang", "tokenizer")
LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


def distinct_lines(raw: bytes) -> bytes:
    """A text without lines that equal an earlier line of it; lines without words stay."""
    seen: set[bytes] = set()
    kept = []
    for line in raw.split(b"\n"):
        if line.strip() and line in seen:
            continue
        seen.add(line)
        kept.append(line)
    return b"\n".join(kept)


class _Lengths(WordEncoder):
    """Remembers the number of ids of a word in place of the ids."""

    def count(self, texts: list[bytes]) -> list[int]:
        return [len(x) // 4 for x in self.encode(texts)]


def count_tokens(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, tokens and clean_tokens (without repeated lines) of every row, in one pass.

    Null and empty texts have no tokens; null ids, sources and languages stay
    null; repeated rows are counted each for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("lengths", tokenizer), lambda: _Lengths(tokenizer))
        for batch in batches:
            tokens, cleaned = [], []
            for _, texts in text_chunks(batch):
                own = encoder.count(texts)
                fewer = [distinct_lines(t) for t in texts]
                changed = [i for i, (a, b) in enumerate(zip(texts, fewer)) if len(a) != len(b)]
                again = dict(zip(changed, encoder.count([fewer[i] for i in changed])))
                tokens += own
                cleaned += [again.get(i, n) for i, n in enumerate(own)]
            columns = [batch.column(k) for k in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tokens, pa.int64()), pa.array(cleaned, pa.int64())], ["doc_id", "source", "lang", "tokens", "clean_tokens"])

    rows = documents.selectExpr("cast(doc_id as long) as doc_id", "text", "cast(source as string) as source", "cast(lang as string) as lang")
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long, clean_tokens long")


class TokenRollups:
    """A ledger of signed counts below ``root``, and the totals that it adds up to.

    Events are rows of doc_id, source, lang, tokenizer, op (``insert``,
    ``delete`` or ``revise``) and tokens, optionally with seq; other columns are
    not read.  Of several events of one (doc_id, tokenizer) in a batch the last
    counts: by seq, else by op and tokens.  An insert of a document that is
    there, and a revision of one that is not, both set its count; deleting one
    that is not there does nothing.  Null keys are values like others; null
    tokens count as 0.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, root)

    def _log(self) -> list[dict]:
        """The log's entries in order: each has batches, folder and full (whether it stands for all before it)."""
        return [json.loads(self.files.text(f"log/{x.name}")) for x in self.files.listed("log")]

    def _take(self, number: int, entry: dict) -> bool:
        """Make ``entry`` the log's number ``number``, whole or not at all; False if another writer has it."""
        return self.files.put_once(f"log/{number:08d}", json.dumps(entry) + "\n")

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        return sorted(b for e in self._log() for b in e["batches"])

    def _read(self, log: list[dict], part: str, schema: str) -> DataFrame:
        start = max((k for k, e in enumerate(log) if e["full"]), default=0)
        folders = [f"{self.root}/{e['folder']}/{part}" for e in log[start:]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """Signed rows of all committed batches."""
        return self._read(self._log(), "ledger", LEDGER)

    def current(self) -> DataFrame:
        """What the ledger says of each document: one row for each (doc_id, tokenizer) that is there."""
        return _net(self.ledger()).filter("docs > 0")

    def _signed(self, log: list[dict], events: DataFrame) -> DataFrame:
        """The ledger rows that a batch of events amounts to: minus what was, plus what is.

        Of the ledger only rows of the documents in the batch are added up.
        """
        seq = F.col("seq") if "seq" in events.columns else F.lit(0)
        events = events.select("doc_id", *GROUP, "op", "tokens", seq.alias("seq"))
        order = Window.partitionBy("doc_id", "tokenizer").orderBy(F.col("seq").desc(), F.col("op").desc(), F.coalesce("tokens", F.lit(0)).desc(), F.col("source"), F.col("lang"))
        last = events.withColumn("__n", F.row_number().over(order)).filter("__n = 1")
        new = last.filter("op <> 'delete'").select("doc_id", *GROUP, F.lit(1).cast("long").alias("docs"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
        if not log:
            return new
        touched = last.select(F.col("doc_id").alias("__id"), F.col("tokenizer").alias("__tokenizer"))
        ledger = self._read(log, "ledger", LEDGER)
        old = _net(ledger.join(touched, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("tokenizer").eqNullSafe(F.col("__tokenizer")), "left_semi")).filter("docs > 0")
        both = old.select("doc_id", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")).unionByName(new)
        return _net(both).filter("docs <> 0 or tokens <> 0")

    def _write(self, label: str, rows: DataFrame) -> str:
        """Ledger and totals of ``rows`` in a folder of their own, which no reader knows yet."""
        folder = f"data/{label}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}/ledger")
        written = self.spark.read.schema(LEDGER).parquet(f"{self.root}/{folder}/ledger")
        written.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.root}/{folder}/totals")
        return folder

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Apply a batch of events; False, and no work, if a batch of this name is committed.

        The commit is the log entry.  Whoever finds its number taken by another
        batch starts again from the ledger as it is then.  A driver lost before
        its entry leaves a folder that no reader looks at.
        """
        while True:
            log = self._log()
            if any(batch in e["batches"] for e in log):
                return False
            folder = self._write("batch", self._signed(log, events))
            if self._take(len(log), {"batches": [batch], "folder": folder, "full": False}):
                return True
            delete_path(self.spark, f"{self.root}/{folder}")

    def compact(self) -> bool:
        """Write what the ledger adds up to as one entry that stands for all before it; False if another writer came first."""
        log = self._log()
        folder = self._write("full", _net(self._read(log, "ledger", LEDGER)).filter("docs <> 0 or tokens <> 0"))
        if self._take(len(log), {"batches": [], "folder": folder, "full": True}):
            return True
        delete_path(self.spark, f"{self.root}/{folder}")
        return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens, summed over the committed batches' deltas."""
        sums = self._read(self._log(), "totals", TOTALS).groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")


def _net(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
