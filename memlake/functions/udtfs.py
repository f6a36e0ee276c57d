"""Chunkers and turn pairing as table functions, for queries written in SQL: register_all(spark) makes them known to a session.

    select d.doc_id, c.* from documents d, lateral chunk_text(d.text, 'markdown') c
    select * from turn_pairs(table(turns) partition by session order by pos)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from memlake.operators import chunkers  # noqa: F401 - registers its chunkers
from memlake.operators.turns import SKIPPED
from memlake.registry import lookup

CHUNK = StructType().add("chunk_idx", IntegerType()).add("document", StringType()).add("tokens", LongType())


class ChunkText:
    """chunk_text(text, chunker): (chunk_idx, document, tokens) by a registered chunker, markdown unless named; a null text has none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, chunker: AnalyzeArgument | None = None) -> AnalyzeResult:
        if chunker is not None:
            if not chunker.isConstantExpression:
                raise ValueError("the chunker must be a constant")
            lookup("chunker", chunker.value)  # an unknown name fails when the query is analysed
        return AnalyzeResult(schema=CHUNK)

    def eval(self, text: str | None, chunker: str = "markdown") -> Iterator[tuple[int, str, int]]:
        for i, piece in enumerate(lookup("chunker", chunker)(text) if text is not None else []):
            yield i, piece, chunkers.tokens(piece)


class TurnPairs:
    """turn_pairs(table(...)): (session, turn_index, user_pos, answers) of rows (session, pos, type).

    The function asks for its rows by session and in order, unless the query says so
    itself; one session's rows are read one by one, of which only the open pair is held.
    """

    @staticmethod
    def analyze(turns: AnalyzeArgument) -> AnalyzeResult:
        if not turns.isTable:
            raise ValueError("turn_pairs takes a table")
        kinds = {f.name: f.dataType for f in turns.dataType.fields}
        if missing := {"session", "pos", "type"} - set(kinds):
            raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
        schema = StructType().add("session", kinds["session"]).add("turn_index", LongType()).add("user_pos", LongType()).add("answers", ArrayType(LongType()))
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("session")], orderBy=[OrderingColumn("pos")])

    def __init__(self) -> None:
        self.turn, self.open = -1, None

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["type"] in SKIPPED:
            return
        if row["type"] == "user":
            yield from self.terminate()
            self.turn += 1
            self.open = (row["session"], self.turn, row["pos"], [])
        elif row["type"] == "assistant" and self.open:
            self.open[3].append(row["pos"])

    def terminate(self) -> Iterator[tuple]:
        if self.open:
            yield self.open
        self.open = None


def register_all(spark: SparkSession) -> None:
    """Make chunk_text and turn_pairs callable from the session's SQL."""
    for name, kind in {"chunk_text": ChunkText, "turn_pairs": TurnPairs}.items():
        spark.udtf.register(name, udtf(kind))
