"""Column functions that read answers and instructions; each is an expression over a text, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of bracketed instructions by task type; of two, the first that matches counts.
_B = r"\[([^\]]+)\]"
INSTRUCTION_PATTERNS: dict[str, tuple[str, ...]] = {
    "subject_replace": (rf"Replace {_B} with {_B}",),
    "subject_remove": (rf"Remove {_B}",),
    "material_alter": (rf"Change the material of {_B} to {_B}",),
    "color_alter": (rf"Change the color of {_B} to {_B}",),
    "subject_add": (rf"Add {_B} on the {_B} of {_B}", rf"Add {_B}"),
    "text_change": (rf"Replace the text '{_B}' on {_B} with '{_B}'", rf"Add text '{_B}' on the image"),
    "position_change": (rf"Change the position of {_B} to {_B} of {_B}",),
    "count_change": (rf"Change the count of {_B} to {_B}",),
    "background_change": (r"Change the background to ([^,]+), remain the (.+) unchanged", rf"Change the background to {_B}"),
}
# Directions of a relative position.
DIRECTIONS = ("left", "right", "above", "below")


def parse_instruction(task: Column | str, text: Column | str) -> Column:
    """The parts of an instruction as array<string>, null if it has none of its task's forms.

    The form is found as a whole, then its bracketed parts are taken in order; kept objects are a list in one part.
    """
    task, text = (F.col(c) if isinstance(c, str) else c for c in (task, text))

    def form(k: int) -> Column:
        known = [(name, patterns[k]) for name, patterns in INSTRUCTION_PATTERNS.items() if len(patterns) > k]
        pattern = F.lit(None).cast("string")
        for name, p in known:
            pattern = F.when(task == name, p).otherwise(pattern)
        return F.nullif(F.call_function("regexp_extract", text, pattern, F.lit(0)), F.lit(""))

    kept = INSTRUCTION_PATTERNS["background_change"][0]
    unbracketed = F.concat(F.array(F.regexp_extract(text, kept, 1)), F.split(F.regexp_extract(text, kept, 2), ","))
    return F.when((task == "background_change") & text.rlike(kept), unbracketed).otherwise(F.regexp_extract_all(F.coalesce(form(0), form(1)), F.lit(_B), 1))


def valid_instruction(task: Column | str, parts: Column | str) -> Column:
    task, parts = (F.col(c) if isinstance(c, str) else c for c in (task, parts))
    directed = (task == "position_change") | ((task == "subject_add") & (F.size(parts) == 3))
    good = F.when(task == "count_change", parts[1].rlike("^[0-9]+$")).when(directed, parts[1].isin(*DIRECTIONS)).otherwise(True)
    return F.coalesce(parts.isNotNull() & good, F.lit(False))


def singular(word: Column | str) -> Column:
    """Without a closing es, or else s."""
    word = F.col(word) if isinstance(word, str) else word
    return F.when(word.endswith("es"), F.left(word, F.char_length(word) - 2)).when(word.endswith("s"), F.left(word, F.char_length(word) - 1)).otherwise(word)


# The four forms of a line that says yes or no.
_TOKEN = "[\"'“”‘’]?(yes|no)[\"'“”‘’]?"
DECISION_PATTERNS = (
    rf"(?i)^{_TOKEN}[.!]?\s*$",
    rf"(?i)^{_TOKEN}[,.!:]\s+\S",
    rf"(?i)^(?:(?:therefore|thus|so|hence)[,:]?\s+)?(?:(?:the|my)\s+)?(?:(?:final|correct)\s+)?(?:answer|response)\s*(?:is\s+|:\s*){_TOKEN}[.!]?\s*$",
    rf"(?i)^(?:therefore|thus|so|hence)[,:]?\s+{_TOKEN}[.!]?\s*$",
)


def decision(text: Column | str) -> Column:
    """'yes' or 'no' if the lines that decide agree; null without a decision or with both."""
    lines = F.transform(F.split(text, r"\R"), lambda line: F.trim(F.regexp_replace(line, "[*`]", "")))
    said = F.flatten(F.transform(lines, lambda line: F.array(*[F.lower(F.regexp_extract(line, p, 1)) for p in DECISION_PATTERNS])))
    answers = F.array_distinct(F.filter(said, lambda a: a != ""))
    return F.when(F.size(answers) == 1, answers[0])


def verdict(text: Column | str, turns: Column | str) -> Column:
    """struct<status, score, reason> of a tagged verdict: one final tag, turn tags 1, 2, ... with yes up to the first no."""
    text, turns = (F.col(c) if isinstance(c, str) else c for c in (text, turns))
    turn_tag = r"(?i)<answer_turn_(\d+)>\s*(yes|no)\s*</answer_turn_\1>"
    final = F.regexp_extract_all(text, F.lit(r"(?i)<answer_final>\s*(yes|no)\s*</answer_final>"), 1)
    ids = F.transform(F.regexp_extract_all(text, F.lit(turn_tag), 1), lambda x: x.cast("int"))
    values = F.transform(F.regexp_extract_all(text, F.lit(turn_tag), 2), F.lower)
    n = F.size(ids)
    in_order = (n > 0) & (ids == F.sequence(F.lit(1), F.greatest(n, F.lit(1)))) & (n <= turns)
    yes = F.lower(F.get(final, F.lit(0))) == "yes"
    all_yes = F.forall(values, lambda v: v == "yes")
    stops = (F.element_at(values, -1) == "no") & F.forall(F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda v: v == "yes")
    reason = (
        F.when((F.size(final) != 1) | (n == 0), "missing or repeated answer tags")
        .when(~in_order, "turn sequence invalid")
        .when(yes & ~((n == turns) & all_yes), "inconsistent yes")
        .when(~yes & ~stops, "no must stop at the first failure")
    )
    return F.struct(F.when(reason.isNull(), "ok").otherwise("pending_review").alias("status"), F.when(reason.isNull(), yes.cast("double")).alias("score"), reason.alias("reason"))


def caption(names: Column | str) -> Column:
    """Detector caption of a list of names: trimmed, lower-cased, without dots, joined and closed by dots."""
    return F.concat(F.array_join(F.transform(names, lambda n: F.replace(F.lower(F.trim(n)), F.lit("."), F.lit(""))), " . "), F.lit(" ."))


def incomplete_cause(finish: Column | str, raw: Column | str) -> Column:
    finish, raw = (F.col(c) if isinstance(c, str) else c for c in (finish, raw))
    return F.when(finish == "length", "token_limit").when((finish == "stop") & (F.trim(raw) == ""), "empty_response")


def metric_parts(name: Column | str) -> list[Column]:
    """Parts of a metric name such as t3__T1:mass@L12H4."""
    pattern = r"^t(\d+)__([^:]+):([a-z0-9_]+)(?:@L(\d+)H(\d+))?$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return [part(1).cast("long").alias("turn"), part(2).alias("object"), part(3).alias("metric"), part(4).cast("long").alias("layer"), part(5).cast("long").alias("head")]
