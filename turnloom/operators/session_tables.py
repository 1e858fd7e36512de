"""A table function over the supports of a session: group, combined image, category and object rows from the arrays of all its positions.

It takes a table partitioned by session. A session's positions come one after another, and only sums are held; rows are given when the session ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

# built from types, as the function is analysed in a worker without a session
SCHEMA = StructType()
for _name, _type in (("session", LongType()), ("kind", StringType()), ("name", StringType()), ("role", StringType()), ("age", LongType()), ("mass", DoubleType()), ("tokens", LongType()), ("density", DoubleType()), ("enrichment", DoubleType()), ("null_reason", StringType())):
    SCHEMA.add(_name, _type)
#: The groups of a turn of two instructions and two images, in the order of their tokens.
GROUPS = ("T1", "T2", "I0_vit", "I0_vae", "I1_vit", "I1_vae", "target_image", "context_other")
CATEGORIES = {"history_instructions": ("T1",), "current_instruction": ("T2",), "original_image": ("I0_vit", "I0_vae"), "history_images": ("I1_vit", "I1_vae"), "target_image": ("target_image",), "context_other": ("context_other",)}
OBJECTS = {"T1": ("history_instruction", 1), "T2": ("current_instruction", 0), "I0_vit": ("original_image", 1), "I0_vae": ("original_image", 1), "I1_vit": ("history_image", 0), "I1_vae": ("history_image", 0)}
COMBINED = {"I0_combined": ("I0_vit", "I0_vae"), "I1_combined": ("I1_vit", "I1_vae")}


class SessionTables:
    """TABLE(session long, position long, masses array<double>, tokens array<long>) -> rows of SCHEMA. masses and tokens have an entry for each group."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        names = [f.name for f in rows.dataType.fields] if rows.isTable else []
        if names != ["session", "position", "masses", "tokens"]:
            raise ValueError(f"SessionTables takes a table of session, position, masses, tokens; it got {names}")
        return AnalyzeResult(schema=SCHEMA, partitionBy=[PartitioningColumn("session")], orderBy=[OrderingColumn("position")])

    def __init__(self):
        self.session, self.n, self.sums, self.tokens = None, 0, [0.0] * len(GROUPS), [0] * len(GROUPS)

    def eval(self, row):
        if self.n and list(row["tokens"]) != self.tokens:
            raise ValueError(f"session {row['session']}: the token counts of its positions differ")
        self.session, self.tokens, self.n = row["session"], list(row["tokens"]), self.n + 1
        self.sums = [a + b for a, b in zip(self.sums, row["masses"], strict=True)]

    def terminate(self):
        if not self.n:
            return
        mass = dict(zip(GROUPS, (s / self.n for s in self.sums), strict=True))
        tokens = dict(zip(GROUPS, self.tokens, strict=True))
        whole = sum(self.tokens)

        def row(kind, name, groups, role=None, age=None):
            m, n = sum(mass[g] for g in groups), sum(tokens[g] for g in groups)
            return self.session, kind, name, role, age, m, n, m / n if n else None, m / (n / whole) if n else None, None if n else "structural_zero"

        for g in GROUPS:
            yield row("group", g, (g,))
        for name, groups in COMBINED.items():
            yield row("image", name, groups)
        for name, groups in CATEGORIES.items():
            yield row("category", name, groups)
        for g, (role, age) in OBJECTS.items():
            yield row("object", g, (g,), role, age)
        for name, groups in COMBINED.items():
            role, age = OBJECTS[groups[0]]
            yield row("object", name, groups, role, age)


def session_tables(rows: DataFrame) -> DataFrame:
    """rows: (session, position, masses, tokens). The partitioning comes from the function's own analysis."""
    function = F.udtf(SessionTables)
    spark = rows.sparkSession
    spark.udtf.register("session_tables", function)
    view = f"session_positions_{id(rows)}"
    rows.select("session", "position", "masses", "tokens").createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM session_tables(TABLE({view}))")
