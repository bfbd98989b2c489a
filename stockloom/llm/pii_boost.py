"""Personal data by candidate generation and gradient boosting.

Fixed patterns with checks give the base spans. High-recall generators run over what is left
and propose further spans. Boosted trees judge a candidate by its format and its context; a
threshold per kind, calibrated on judged candidates, selects what is redacted.
Everything that touches documents is built of SQL functions: patterns are found with
``regexp_extract_all``, their places follow from the lengths of the pieces between them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.session import scratch_dir, written

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written without backtracking: an address or number is looked for only at the
# start of a run of its characters, where the leftmost match must begin.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Generators of candidates over the text without base spans.
LOOSE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?(?:@|\(at\)|\[at\]|\{{at\}})\x20?[A-Za-z0-9-]++"
             r"(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
          r"|(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20\.\x20)[0-9]{1,3}){3}(?![0-9])",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"(?<![0-9A-Za-z.+])\(?[0-9]{2,4}\)?(?:[\x20./-]\(?[0-9]{2,5}\)?){1,4}(?![0-9A-Za-z])",
}
FILL = {kind: chr(0xFDD0 + i) for i, kind in enumerate(KINDS)}  # non-characters, never in a text
LABEL = {kind: f"[{kind.upper()}]" for kind in KINDS}
MASK_ORDER = ("email", "phone", "card", "ip")
CONTEXT = 24  # code points looked at on either side

CUES = {
    "email": r"(?i)(e-?mail|mailto|contact|write)\W*$", "ip": r"(?i)(\bip|addr|address|host|server)\W*$",
    "card": r"(?i)(card|visa|credit|amex|account)\W*$", "phone": r"(?i)(tel|phone|call|fax|mobile|cell|ring)\W*$",
}
TREES, RATE, COMBINATIONS, PRECISION = 40, 0.3, 20_000, 0.95
_SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"

# Judged examples (kind, value, text before, text after, personal). They stand beside the corpus so that
# forms it happens to lack are known; each has the weight EXAMPLE_WEIGHT, whatever the corpus counts.
EXAMPLES = (
    ("email", "jane (at) mail (dot) org", "write to ", " soon", 1), ("email", "j.doe[at]mail[dot]org", "contact: ", "", 1),
    ("email", "ann @ home.example.org", "mail ", ",", 1), ("email", "met @ 10.30", "we ", " sharp", 0),
    ("email", "3 @ 4.50", "buy ", " each", 0), ("email", "v2 @ 1.0.3", "pin ", "", 0),
    ("phone", "(415) 555-2671", "call ", " today", 1), ("phone", "415-555-2671", "tel. ", ".", 1),
    ("phone", "020 7946 0958", "phone ", "", 1), ("phone", "415 555 2671", "mobile: ", ",", 1),
    ("phone", "2019-2020", "in ", " the", 0), ("phone", "12/05/2021", "on ", ",", 0), ("phone", "2021-05-12", "on ", " at", 0),
    ("phone", "10.30", "at ", "", 0), ("phone", "100 000", "of ", " men", 0), ("phone", "12 34 56", "rows ", " and", 0),
    ("phone", "1984/85", "in ", "", 0), ("phone", "555-0199", "unit ", " of", 0), ("phone", "978-3-16-148410-0", "ISBN ", "", 0),
    ("card", "4111 1111 1111 1112", "card ", "", 1), ("card", "4111-1111-1111-1113", "visa ", ".", 1),
    ("card", "20210512103059", "log ", "", 0), ("card", "9780306406157", "ISBN ", "", 0), ("card", "1234567890123456", "id ", "", 0),
    ("card", "10 20 30 40 50 60 70", "rows ", "", 0), ("ip", "10[.]0[.]0[.]7", "host ", "", 1), ("ip", "192(.)168(.)1(.)20", "ip ", "", 1),
    ("ip", "2001:0db8:0000:0000:0000:ff00:0042:8329", "address ", "", 1), ("ip", "00:11:22:33:44:55:66:77", "key ", "", 0),
    ("ip", "12:30:45:10:20:30:40:50", "at ", "", 0),
)
EXAMPLE_WEIGHT = 30


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.char_length(digits)

    def step(total: Column, i: Column) -> Column:
        digit = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def is_valid(kind: str, value: Column) -> Column:
    """The check that a match of a base pattern has to pass."""
    if kind == "email":
        return value.isNotNull()
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    count = F.char_length(_digits(value))
    if kind == "phone":
        return count.between(10, 15)
    return F.when(count.between(14, 19), luhn(_digits(value))).otherwise(False)


def _gate(text: Column, kind: str) -> Column:
    return F.contains(text, F.lit("@")) | text.rlike(r"[\(\[\{]at[\)\]\}]") if kind == "email" else text.rlike("[0-9]")


def find(text: Column, kind: str, patterns: dict[str, str], check) -> Column:
    """Matches of a pattern that pass ``check``, leftmost first: place in code points, value and context."""
    pattern = patterns[kind]
    parts = F.split(text, pattern, -1)
    pieces = F.arrays_zip(
        parts.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.slice(F.split(text, pattern, -1), F.lit(2), F.size(F.split(text, pattern, -1))).alias("rest"),
    )

    def step(state: Column, piece: Column) -> Column:
        gap, hit = piece["gap"], piece["hit"]
        start = state["at"] + F.char_length(gap)
        end = start + F.coalesce(F.char_length(hit), F.lit(0))
        span = F.struct(
            start.alias("start"), end.alias("end"), hit.alias("value"), F.right(gap, F.lit(CONTEXT)).alias("before"),
            F.left(F.coalesce(piece["rest"], F.lit("")), F.lit(CONTEXT)).alias("after"),
        )
        keep = hit.isNotNull() & check(hit)
        return F.struct(end.alias("at"), F.when(keep, F.array_append(state["found"], span)).otherwise(state["found"]).alias("found"))

    none = F.array().cast(_SPAN)
    return F.when(
        _gate(text, kind),
        F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda s: s["found"]),
    ).otherwise(none)


def mask(text: Column, kind: str, patterns: dict[str, str], check) -> Column:
    """The text with each match that passes ``check`` overwritten by the filler of its kind."""
    pattern = patterns[kind]
    covered = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.concat(
            gap, F.coalesce(F.when(check(hit), F.repeat(F.lit(FILL[kind]), F.char_length(hit))).otherwise(hit), F.lit(""))
        ),
    )
    return F.when(_gate(text, kind), F.array_join(covered, "")).otherwise(text)


def _loose_check(kind: str):
    if kind == "phone":
        return lambda v: F.char_length(_digits(v)).between(7, 15)
    if kind == "card":
        return lambda v: F.char_length(_digits(v)).between(13, 19)
    return lambda v: v.isNotNull()


def _edge(char: Column) -> Column:
    return (
        F.when(char.isNull() | char.rlike(r"^\s?$"), 0).when(char.rlike(r"^\p{L}"), 1).when(char.rlike("^[0-9]"), 2)
        .when(char.rlike("^[\"'=:/]"), 3).otherwise(4)
    )


def _binned(value: Column, tops: tuple[int, ...]) -> Column:
    bin_ = F.lit(len(tops))
    for i in range(len(tops) - 1, -1, -1):
        bin_ = F.when(value <= tops[i], i).otherwise(bin_)
    return bin_


FEATURES = ("kind", "digits", "groups", "run", "space", "hyphen", "dot", "paren", "colon", "left", "right", "cue")


def features(kind: str, span: Column) -> Column:
    """Small integers on the form of a candidate and what stands around it; the base checks are not among them."""
    value = F.regexp_replace(span["value"], r"^\+", "")
    runs = F.transform(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), F.char_length)
    has = lambda p: value.rlike(p).cast("int")
    found = (
        F.lit(KINDS.index(kind)), _binned(F.char_length(_digits(value)), (0, 6, 8, 9, 10, 11, 12, 13, 14, 15, 16, 19)),
        _binned(F.size(runs), (0, 1, 2, 3, 4)), _binned(F.coalesce(F.array_max(runs), F.lit(0)), (0, 3, 4, 7, 12)),
        has(r"\s"), has("-"), has(r"\."), has(r"[\(\[\{]"), has(":"), _edge(F.right(span["before"], F.lit(1))),
        _edge(F.left(span["after"], F.lit(1))), span["before"].rlike(CUES[kind]).cast("int"),
    )
    return F.struct(*[f.cast("int").alias(n) for f, n in zip(found, FEATURES)])


@dataclass
class Trees:
    """Boosted trees of depth two over small integers and a threshold of the score per kind."""

    base: float = 0.0
    nodes: list[tuple] = field(default_factory=list)  # (feature, top, low split, high split), a split (feature, top, value, value)
    thresholds: dict[int, float] = field(default_factory=dict)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, top, low, high in self.nodes:
            for side, (g, cut, a, b) in ((x[:, f] <= top, low), (x[:, f] > top, high)):
                total[side] += np.where(x[side, g] <= cut, a, b)
        return total

    def column(self, row: Column) -> Column:
        total = F.lit(self.base)
        get = lambda f: row[FEATURES[f]]
        for f, top, low, high in self.nodes:
            leaf = lambda s: F.when(get(s[0]) <= s[1], F.lit(s[2])).otherwise(F.lit(s[3]))
            total = total + F.when(get(f) <= top, leaf(low)).otherwise(leaf(high))
        return total

    def selects(self, kind: str, row: Column) -> Column:
        least = self.thresholds.get(KINDS.index(kind))
        return F.lit(False) if least is None else self.column(row) >= F.lit(least)


def _split(x, gradient, hessian, use):
    """Best cut of the rows in ``use``: gain, feature and top of its low side."""
    best = (-1.0, 0, int(x[use, 0].max(initial=0)))
    g, h = gradient[use].sum(), hessian[use].sum()
    for f in range(x.shape[1]):
        for top in np.unique(x[use, f])[:-1]:
            low = use & (x[:, f] <= top)
            a, b = gradient[low].sum(), hessian[low].sum()
            gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
            if gain > best[0] + 1e-12:
                best = (gain, f, int(top))
    return best


def boost(x: np.ndarray, positive: np.ndarray, weight: np.ndarray, trees: int = TREES, rate: float = RATE) -> Trees:
    """Newton boosting of the logistic loss on aggregated rows: ``positive`` of ``weight`` candidates are personal."""
    share = (positive.sum() + 1) / (weight.sum() + 2)
    model = Trees(float(np.log(share / (1 - share))))
    score = np.full(len(x), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = positive - weight * p, weight * p * (1 - p)
        everything = np.ones(len(x), bool)
        gain, f, top = _split(x, gradient, hessian, everything)
        if gain <= 0:
            break
        sides = []
        for side in (x[:, f] <= top, x[:, f] > top):
            _, g, cut = _split(x, gradient, hessian, side)
            leaf = []
            for part in (side & (x[:, g] <= cut), side & (x[:, g] > cut)):
                leaf.append(float(rate * gradient[part].sum() / (hessian[part].sum() + 1)))
                score[part] += leaf[-1]
            sides.append((g, cut, *leaf))
        model.nodes.append((f, top, *sides))
    return model


def calibrate(model: Trees, x: np.ndarray, positive: np.ndarray, weight: np.ndarray, precision: float = PRECISION) -> None:
    """Per kind the lowest score from which on at least ``precision`` of the judged candidates are personal."""
    scores = model.scores(x)
    for kind in range(len(KINDS)):
        own = np.flatnonzero(x[:, 0] == kind)
        own = own[np.argsort(-scores[own], kind="stable")]
        if not len(own):
            continue
        reached = np.cumsum(positive[own]) / np.maximum(np.cumsum(weight[own]), 1e-9)
        last = np.r_[scores[own][1:] != scores[own][:-1], True]  # a threshold takes all of equal score
        good = np.flatnonzero(last & (reached >= precision))
        if len(good):
            model.thresholds[kind] = float(scores[own][good[-1]])


def _typed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], F.lit(KINDS.index(kind)).alias("kind"), s["end"], features(kind, s).alias("f")))


def locate(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, base, loose`` of every row: spans as arrays of ``start, kind, end, f`` in order of start and kind.

    ``base`` has the base spans, found kind by kind in the whole text; ``loose`` the candidates that the
    generators propose where base spans are blanked out. Texts themselves are not kept.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    some = F.col("__text").rlike("[0-9@]|[\\(\\[\\{]at[\\)\\]\\}]")
    rows = docs.select("doc_id", whole.alias("__text"))
    # One projection per step, so that no step is computed inside the loops of the next.
    rows = rows.withColumn("__some", some)
    for kind in MASK_ORDER:
        before = "__text" if kind == MASK_ORDER[0] else "__masked"
        step = mask(F.col(before), kind, PATTERNS, lambda v, k=kind: is_valid(k, v))
        rows = rows.withColumn("__masked", F.when(F.col("__some"), step).otherwise(F.lit("")))
    order = lambda columns: F.array_sort(F.concat(*columns))
    base = [_typed(find(F.col("__text"), k, PATTERNS, lambda v, k=k: is_valid(k, v)), k) for k in KINDS]
    loose = [_typed(find(F.col("__masked"), k, LOOSE, _loose_check(k)), k) for k in KINDS]
    none = F.array().cast(f"array<struct<start:int,kind:int,end:int,f:struct<{','.join(f'{n}:int' for n in FEATURES)}>>>")
    return rows.select(
        "doc_id", F.when(F.col("__some"), order(base)).otherwise(none).alias("base"),
        F.when(F.col("__some"), order(loose)).otherwise(none).alias("loose"),
    )


def train(spark: SparkSession, located: DataFrame) -> Trees:
    """Trees fitted on base spans and judged examples, with thresholds calibrated on the judged examples alone.

    Base spans of all documents are personal. They are counted per combination of features, the
    ``COMBINATIONS`` most frequent are used, and those of a kind weigh together as much as its judged examples:
    neither the size of the corpus nor its share of base spans moves a score. Candidates outside of
    base spans have no label and count neither way. Base spans need no threshold, so they play no part in
    the precision.
    """
    found = located.select(F.explode("base").alias("s")).select("s.f").groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    counted = np.array([(*r.f, r.n) for r in found.orderBy(F.desc("n"), "f").limit(COMBINATIONS).collect()], float)
    judged = spark.createDataFrame(list(EXAMPLES), "kind string, value string, before string, after string, personal int")
    form = F.lit(None)
    for kind in KINDS:
        form = F.when(F.col("kind") == kind, features(kind, F.struct("value", "before", "after"))).otherwise(form)
    judged = np.array([(*r.f, r.personal * EXAMPLE_WEIGHT, EXAMPLE_WEIGHT) for r in judged.select(form.alias("f"), "personal").collect()], float)
    counted = counted.reshape(-1, len(FEATURES) + 1)
    weight = np.zeros(len(counted))
    for kind in range(len(KINDS)):
        own = counted[:, 0] == kind
        weight[own] = counted[own, -1] / max(counted[own, -1].sum(), 1) * judged[judged[:, 0] == kind, -1].sum()
    table = np.concatenate([np.column_stack([counted[:, :-1], weight, weight]), judged])
    model = boost(table[:, :-2].astype(int), table[:, -2], table[:, -1])
    calibrate(model, judged[:, :-2].astype(int), judged[:, -2], judged[:, -1])
    return model


def select(located: DataFrame, model: Trees) -> DataFrame:
    """``doc_id, base, spans``: the base spans and, with them, the candidates whose score reaches their threshold."""
    chosen = F.lit(False)
    keep = lambda s: F.coalesce(
        *[F.when(s["kind"] == i, model.selects(k, s["f"])) for i, k in enumerate(KINDS)], chosen
    )
    plain = lambda a: F.transform(a, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return located.select(
        "doc_id", plain(F.col("base")).alias("base"),
        F.array_sort(F.array_distinct(F.concat(plain(F.col("base")), plain(F.filter("loose", keep))))).alias("spans"),
    )


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def detect(docs: DataFrame) -> DataFrame:
    """Spans of every whole text: ``doc_id, base, spans``.

    Null texts count as empty and have none. Every row keeps its own result, repeated rows too; an
    empty table gives no rows (the judged examples alone train the trees) and other columns are
    ignored.
    """
    located = written(locate(docs), scratch_dir(docs.sparkSession, "located"))
    return select(located, train(docs.sparkSession, located))


def redact(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """The rows with every selected span of ``text`` replaced by the label of its kind; null texts stay null.

    Spans that touch or overlap become one label per kind; no character of a span is left. Texts
    without digits or address marks pass unchanged, all other columns stay as they are.
    """
    whole = docs.columns
    rows = docs.withColumn("__masked", F.col(text))
    some = F.col(text).rlike("[0-9@]|[\\(\\[\\{]at[\\)\\]\\}]")
    for kind in MASK_ORDER:
        step = mask(F.col("__masked"), kind, PATTERNS, lambda v, k=kind: is_valid(k, v))
        rows = rows.withColumn("__masked", F.when(some, step).otherwise(F.col("__masked")))
    for kind in KINDS:
        rows = rows.withColumn("__masked", F.when(some, _cover(F.col("__masked"), kind, model)).otherwise(F.col("__masked")))
    done = F.col("__masked")
    for kind in KINDS:
        done = F.regexp_replace(done, f"{FILL[kind]}+", LABEL[kind].replace("[", "\\[").replace("]", "\\]"))
    final = F.when(some, done).otherwise(F.col(text))
    return rows.select(*[final.alias(text) if c == text else F.col(f"`{c}`") for c in whole])


def _cover(text: Column, kind: str, model: Trees) -> Column:
    """The text with the selected candidates of a kind overwritten by its filler."""
    pattern, check = LOOSE[kind], _loose_check(kind)
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.slice(F.split(text, pattern, -1), F.lit(2), F.size(F.split(text, pattern, -1))).alias("rest"),
    )
    seen = F.transform(pieces, lambda p: F.struct(
        p["gap"].alias("gap"), p["hit"].alias("value"),
        F.when(p["hit"].isNotNull() & check(p["hit"]), features(kind, F.struct(
            p["hit"].alias("value"), F.right(p["gap"], F.lit(CONTEXT)).alias("before"),
            F.left(F.coalesce(p["rest"], F.lit("")), F.lit(CONTEXT)).alias("after")))).alias("f"),
    ))
    joined = F.transform(seen, lambda s: F.concat(s["gap"], F.coalesce(
        F.when(s["f"].isNotNull() & model.selects(kind, s["f"]), F.repeat(F.lit(FILL[kind]), F.char_length(s["value"]))).otherwise(s["value"]),
        F.lit(""))))
    return F.when(_gate(text, kind), F.array_join(joined, "")).otherwise(text)
