"""Column expressions over questions, responses and answers.  All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallgrass.functions import fixed_values as fx


def strip(c: Column) -> Column:
    """Without white space at the ends (``trim`` alone takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def has(c: Column, pattern: str) -> Column:
    """Whether a pattern occurs, in any case."""
    return c.rlike("(?i)" + pattern)


def is_mcq(options: Column) -> Column:
    """A question with a non-empty list of options is multiple choice."""
    return F.coalesce(F.size(options), F.lit(0)) > 0


def blanks(question: Column) -> Column:
    """Number of answer blanks marked in a question."""
    return F.regexp_count(question, F.lit(r"\[ANS\]"))


def blank_count(question: Column, options: Column) -> Column:
    """Answers a question asks for: its blanks, 1 without any, null for multiple choice without any."""
    n = blanks(question)
    return F.when(n > 0, n).when(is_mcq(options), F.lit(None).cast("int")).otherwise(1)


def blank_label(n: Column) -> Column:
    """Group label of a number of blanks: 1 to 5 on their own, then 6-10 and 11+."""
    return F.when(n <= 5, n.cast("string")).when(n <= 10, "6-10").otherwise("11+")


def last_line(c: Column) -> Column:
    """The last line that is not blank, stripped; empty where there is none."""
    lines = F.filter(F.split(c, r"\r\n|[\n\r\x0b\x0c]"), lambda x: strip(x) != "")
    return F.coalesce(strip(F.try_element_at(lines, F.lit(-1))), F.lit(""))


def final_section(c: Column, pattern: str = fx.CLOSE_TAG) -> Column:
    """What follows the last closing tag of the reasoning; the whole text without one."""
    return F.element_at(F.split(c, pattern), -1)


def thinking_open(c: Column) -> Column:
    """Whether the text opens a reasoning section."""
    return c.rlike(fx.OPEN_TAG)


def thinking_closed(c: Column) -> Column:
    """Whether the text closes its reasoning section."""
    return c.rlike(fx.CLOSE_TAG)


def reasoning(c: Column) -> Column:
    """Reasoning of a response: between the tags, or all but the last line without tags."""
    tagged = F.regexp_extract(c, r"(?s)<(?:redacted_)?think(?:ing)?>(.*?)</(?:redacted_)?think(?:ing)?>", 1)
    return F.when(thinking_open(c) & thinking_closed(c), strip(tagged)).otherwise(strip(F.regexp_extract(strip(c), r"(?s)^(.*)\n[^\n]*$", 1)))


def wrap_thinking(body: Column, final: Column) -> Column:
    """A response of a reasoning section and a final line; an empty body leaves its line out."""
    return F.concat(F.lit(fx.THINK_OPEN + "\n"), F.when(body != "", F.concat(body, F.lit("\n"))).otherwise(""), F.lit(fx.THINK_CLOSE + "\n\n"), final)


def overlap_key(c: Column) -> Column:
    """Key under which differently typeset copies of a question are equal.

    Lower case, single blanks, no dollar signs, text commands unwrapped, other characters blank.
    """
    s = F.regexp_replace(F.translate(F.lower(c), "$", ""), r"\\(?:mathrm|mathbf|text|textbf)\{([^}]*)\}", "$1")
    return F.trim(F.regexp_replace(s, r"[^a-z0-9\\=+\-*/^_{}().,\[\]]+", " "))  # white space is among the other characters


def inline_choices(c: Column) -> Column:
    """Whether options (A), (B), (C) stand in the text itself."""
    return F.regexp_count(c, F.lit(r"(?i)\([A-J]\)")) >= fx.INLINE_CHOICES


def boxes(c: Column, pattern: str = fx.ANY_BOX_3) -> Column:
    """Contents of the boxes of a text, with up to three levels of braces (see ``functions.boxes`` beyond)."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def letter(c: Column) -> Column:
    """Chosen option: the first boxed letter anywhere, else the last letter on its own, else empty."""
    boxed = F.upper(F.regexp_extract(c, r"\\boxed\{([A-Za-z])\}", 1))
    alone = F.try_element_at(F.regexp_extract_all(F.upper(c), F.lit(r"\b([A-Z])\b"), F.lit(1)), F.lit(-1))
    return F.coalesce(F.nullif(boxed, F.lit("")), alone, F.lit(""))


def emits_letter(c: Column, options: Column) -> Column:
    """Whether a response boxes a letter that is among its question's options."""
    got = F.upper(F.regexp_extract(c, r"\\boxed\{([A-Za-z])\}", 1))
    return F.coalesce((got != "") & (F.ascii(got) - 65 < F.size(options)), F.lit(False))


def topic_scores(c: Column, rules: Sequence[tuple[str, int, str]] = fx.TOPIC_RULES) -> dict[str, Column]:
    """Summed rule weights by topic."""
    out: dict[str, Column] = {}
    for name, weight, pattern in rules:
        s = F.when(has(c, pattern), weight).otherwise(0)
        out[name] = out[name] + s if name in out else s
    return out


def topic(c: Column, rules: Sequence[tuple[str, int, str]] = fx.TOPIC_RULES) -> Column:
    """Topic with the largest score, the earliest of those tied, ``other`` without any."""
    scores = topic_scores(c, rules)
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("rank"), F.lit(t).alias("topic")) for i, (t, s) in enumerate(scores.items())]))
    return F.when(best["score"] > 0, best["topic"]).otherwise("other")


def source_topic(source: Column, question: Column) -> Column:
    """Topic by keyword, else the source's own name."""
    return F.when(has(question, fx.SEQUENCE_TOPIC), "sequence_recurrence").when(has(question, fx.NUMBER_THEORY), "number_theory").when(has(question, fx.GEOMETRY_TOPIC), "geometry").otherwise(source)


def route(topic_: Column) -> Column:
    """Quota bucket of a topic: a weak topic's own, ``anchor``, or none."""
    return F.when(topic_.isin(*fx.WEAK_BUCKETS), topic_).when(topic_.isin(*fx.ANCHOR_TOPICS), "anchor")


def mix_bucket(question: Column) -> Column:
    """Bucket of a mixed source: weak (geometry, or a long question), adjacent (probability, sequences), else diverse."""
    weak = has(question, fx.GEOMETRY_QUESTION) | (F.length(question) >= fx.LONG_QUESTION)
    return F.when(weak, "weak").when(has(question, fx.PROBABILITY_QUESTION) | has(question, fx.SEQUENCE_QUESTION), "adjacent").otherwise("diverse")


def bucket(value: Column, edges: Sequence[int]) -> Column:
    """Right-closed bucket label: ``<=edge`` of the first edge not exceeded, else ``>last``."""
    out = F.when(value.isNull(), None)
    for e in edges:
        out = out.when(value <= e, f"<={e}")
    return out.otherwise(f">{edges[-1]}")


def uniform(key: Column, seed: int) -> Column:
    """A portable uniform number in [0, 1) from a key: the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def labelled_options(options: Column) -> Column:
    """Options one a line, each with its letter."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), strip(o))), "\n")


def prompt_user(question: Column, options: Column) -> Column:
    """The baseline user prompt."""
    return F.when(is_mcq(options), F.concat(question, F.lit("\n\nOptions:\n"), labelled_options(options))).otherwise(question)


def prompt_system(options: Column) -> Column:
    """The baseline system prompt."""
    return F.when(is_mcq(options), fx.MCQ_BASELINE).otherwise(fx.MATH_BASELINE)


def multi_blank_user(question: Column, options: Column) -> Column:
    """User prompt that names the number of blanks and shows a box for each."""
    n = blanks(question)
    many = F.concat(
        question, F.lit("\n\nThe problem has "), n.cast("string"), F.lit(" [ANS] blanks. After your reasoning, give "), n.cast("string"),
        F.lit(" comma-separated \\boxed{} values in order: "), F.array_join(F.array_repeat(F.lit("\\boxed{...}"), n), ", "),
    )
    return F.when(~is_mcq(options) & (n > 1), many).otherwise(prompt_user(question, options))


def multi_blank_system(question: Column, options: Column) -> Column:
    """System prompt of the multi-blank layout."""
    return F.when(~is_mcq(options) & (blanks(question) > 1), fx.MATH_MULTI_BLANK).otherwise(prompt_system(options))


def exact_user(question: Column, options: Column) -> Column:
    """User prompt of the exact layout (three forms: options, one blank, many blanks)."""
    n = blanks(question).cast("string")
    a, b, c = fx.EXACT_LAYOUT_MANY.split("%d")
    many = F.concat(F.lit(a), n, F.lit(b), n, F.lit(c))
    rule = F.when(is_mcq(options), fx.EXACT_LAYOUT_MCQ).when(blanks(question) > 1, many).otherwise(fx.EXACT_LAYOUT_SINGLE)
    return F.concat(prompt_user(question, options), F.lit("\n\n"), rule)


def exact_system(options: Column) -> Column:
    """System prompt of the exact layout."""
    math = "\n\n".join((fx.EXACT_ROLE_SOLVE, fx.EXACT_PRECISION, fx.EXACT_REPRESENTATION, fx.EXACT_FORMAT))
    return F.when(is_mcq(options), "\n\n".join((fx.EXACT_ROLE_MCQ, fx.EXACT_REPRESENTATION))).otherwise(math)


def prompt_mode(question: Column, options: Column) -> Column:
    """Name of the layout a question gets."""
    return F.when(is_mcq(options), "mcq/exact_v1").when(blanks(question) > 1, "multi-blank/exact_v1").otherwise("single-blank/exact_v1")


def messages(question: Column, options: Column, response: Column) -> Column:
    """Training messages: system, user and assistant turns."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("system", prompt_system(options)), turn("user", prompt_user(question, options)), turn("assistant", response))


def boxed_line(answers: Column) -> Column:
    """Final line with a box for each answer."""
    return F.array_join(F.transform(answers, lambda a: F.concat(F.lit("\\boxed{"), a, F.lit("}"))), ", ")


def pad_blanks(question: Column, n: Column) -> Column:
    """Question with ``Answer: [ANS]`` lines added until it has ``n`` blanks."""
    q = strip(question)
    extra = F.array_join(F.array_repeat(F.lit("Answer: [ANS]"), F.greatest(n - blanks(q), F.lit(0))), "\n")
    return F.when(blanks(q) >= n, q).otherwise(F.when(q == "", extra).otherwise(F.concat(q, F.lit("\n\n"), extra)))


def choice_text(option: Column) -> Column:
    """An option without its (A) label."""
    return F.trim(F.regexp_replace(F.trim(option), r"^\([A-J]\)\s*", ""))


def gold_letter(index: Column, options: Column) -> Column:
    """Letter of a gold index, null out of bounds."""
    return F.when((index >= 0) & (index < F.size(options)), F.char(index + 65))


def token_estimate(*texts: Column, chars_per_token: float = 4.0) -> Column:
    """Offline stand-in for a chat-template token count: characters by a fixed rate (a stub)."""
    return F.ceil(sum((F.length(t) for t in texts), F.lit(0)) / F.lit(chars_per_token)).cast("int")


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two lists hold the same values in any order."""
    return F.array_sort(a) == F.array_sort(b)
