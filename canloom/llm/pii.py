"""Personal data by gradient boosting over candidate spans, in DataFrame functions alone.

Generators of high recall propose spans, which may overlap: the four base formats, and looser ones (addresses
spelt with "at" and "dot", telephone numbers without a plus sign, IPv6, cards with other separators, keys and tokens). Each
candidate has features of its format and its context. Its weak label comes from witnesses: a candidate that fails its
format's check is wrong, one that passes and stands by itself or behind a word that names its kind is right, and one
without a witness teaches nothing. Boosted trees, fitted on the counts of all feature vectors of four folds in five, become a
CASE expression; a threshold for each kind is calibrated on the fifth fold. The trees choose among overlapping spans:
the likelier stays. Base spans always stay, and nothing is added that touches one.

* A feature vector has a bounded number of values (``FEATURES``), so the table of counts that the driver fits
  on is bounded however many documents there are, and covers all of them.
* A kind with fewer than ``SEEN`` labelled candidates in the fifth fold has no threshold; there the weak label decides.
* Base, leftmost and without overlaps within a kind; a match that fails its check is dropped, not retried.
* Very long texts: offsets are running sums in blocks (``_scan``), so work grows with the text and its matches.
* Null texts have no spans. Repeated rows give repeated results; an empty table fits no trees and gives no rows.
  Columns of docs that clash with ours keep their names and values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canloom.llm.common import fresh_name, materialize

#: The base kinds as listed, and behind them what only the method finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

# The base formats. \G or a look-behind keeps a search from starting again inside a run it has just failed on,
# and possessive repeats keep long runs off Java's stack; neither changes what matches.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser formats, by the kind that they would be.
_AT, _DOT, _NAME = r" ?[\[(<] ?(?:at|AT) ?[\])>] ?", r"(?: ?[\[(<] ?(?:dot|DOT) ?[\])>] ?|\.)", "[A-Za-z0-9-]++"
LOOSE = {
    "email": rf"(?<![\w.%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+(?:{_AT}{_NAME}(?:{_DOT}{_NAME})++| (?:at|AT) {_NAME}(?: (?:dot|DOT) {_NAME})++)",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+()-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![\w+/-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+(?![\w+/-])",
}
#: What a text holds that has any span of a format: keeps most texts off the searches.
NEEDS = {
    "email": ("contains(t, '@')", "t rlike '[\\\\[(<] ?(?:at|AT) ?[\\\\])>]| (?:dot|DOT) '"),
    "ip": ("t rlike '[0-9]\\\\.[0-9]'", "t rlike '[0-9A-Fa-f]:[0-9A-Fa-f]'"),
    "card": ("t rlike '[0-9][ -]?[0-9]'", "t rlike '[0-9][._/][0-9]'"),
    "phone": ("t rlike '\\\\+[0-9]'", "t rlike '[0-9][ .-][0-9]'"),
    "secret": ("false", "t rlike '[0-9][A-Za-z]|[A-Za-z][0-9]'"),
}
#: Words before a span that name its kind, for every kind in the four languages of the corpus and English.
CUES = r"(?i)(e-?mail|mail|correo|courriel|phone|tel|call|telefon|teléfono|téléphone|card|karte|tarjeta|carte|visa|ip|host|server|addr|token|key|secret|passw(?:or)?d|pwd|auth)\W*$"
#: Each feature with the number of its values.
FEATURES = {"kind": 5, "loose": 2, "digits": 6, "size": 4, "apart": 3, "letters": 3, "cue": 2, "left": 3, "right": 3}
TREES, DEPTH, RATE = 24, 2, 0.3
#: Of so many folds of texts, the first calibrates.
FOLDS = 5
#: The share of right spans that a threshold asks of the fold kept back, and the evidence it needs.
PRECISION, SEEN = 0.99, 20
#: Elements that a running sum takes at once, and characters of a piece of text.
BLOCK, PIECE = 256, 4096


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value that is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _scan(items: str, zero: str, state: str, step: str) -> str:
    """SQL: array of the states after each item, of type ``state``; ``step`` is over s (the state) and x (an item).

    Blocks hold what a state's array copies: n items cost n * BLOCK / 2 copies and (n / BLOCK)**2 / 2 of blocks.
    """
    inner = f"""aggregate(blk, struct(t.s as s, cast(array() as array<{state}>) as made), (u, x) ->
        {_let('now', f"transform(array(u.s), s -> {step})[0]", "struct(now as s, array_append(u.made, now) as made)")})"""
    blocks = f"transform(sequence(0, (size(its) - 1) div {BLOCK}), k -> slice(its, k * {BLOCK} + 1, {BLOCK}))"
    body = f"""flatten(aggregate({blocks}, struct({zero} as s, cast(array() as array<array<{state}>>) as done),
        (t, blk) -> {_let('part', inner, 'struct(part.s as s, array_append(t.done, part.made) as done)')}, t -> t.done))"""
    return _let("its", items, f"if(size(its) = 0, cast(array() as array<{state}>), {body})")


def _matches(text: str, pattern: str, need: str) -> str:
    """SQL: array of struct(a, b, hit, before, after) for each leftmost match: offsets in code points, and what is around."""
    need = need.replace("(t,", f"({text},").replace("t rlike", f"{text} rlike")
    ends = _scan("zip_with(z.p, z.h, (p, h) -> bigint(length(p) + coalesce(length(h), 0)))", "0L", "bigint", "s + x")
    made = f"""transform(z.h, (h, i) -> struct(e[i] - length(h) as a, e[i] as b, h as hit,
        right(concat(if(i = 0, '', z.h[i - 1]), z.p[i]), 24) as before, left(concat(z.p[i + 1], if(i + 1 < size(z.h), z.h[i + 1], '')), 1) as after))"""
    found = _let("z", f"struct(split({text}, {_quoted(pattern)}, -1) as p, regexp_extract_all({text}, {_quoted(pattern)}, 0) as h)", _let("e", ends, made))
    return f"if({need}, {found}, cast(array() as array<struct<a:bigint,b:bigint,hit:string,before:string,after:string>>))"


def _check(kind: str, loose: int, hit: str) -> str:
    digits = f"regexp_replace({hit}, '[^0-9]', '')"
    if kind == "secret":
        # as mixed as a random key: both sorts of characters, many of them distinct
        return f"length({digits}) >= 4 and length({hit}) - length({digits}) >= 2 and size(array_distinct(split({hit}, ''))) >= 9 and 4 * length(regexp_replace({hit}, '[A-Za-z0-9]', '')) <= length({hit})"
    if loose and kind in ("email", "ip"):
        return "true"
    return {
        "email": "true",
        "ip": f"forall(split({hit}, '\\\\.'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)",
        "card": f"length({digits}) between 13 and 19 and luhn_check({digits})",
        "phone": f"length({digits}) between 9 and 15",
    }[kind]


def _class(c: str) -> str:
    """SQL: 0 blank or none, 1 letter or digit, 2 another sign."""
    return f"case when {c} is null or {c} = '' or {c} rlike '\\\\s' then 0 when {c} rlike '[\\\\p{{L}}\\\\p{{N}}]' then 1 else 2 end"


def candidates(text: str) -> str:
    """SQL: array of the candidate spans of a text with their features, ``ok`` where the format's check passes, and ``label``:
    1 or 0 by the witnesses, -1 without any."""
    found = []
    for k, kind in enumerate(KINDS):
        for loose, formats in ((0, BASE), (1, LOOSE)):
            if kind in formats:
                found.append(f"""transform({_matches(text, formats[kind], NEEDS[kind][loose])}, m -> struct({k} as kind, m.a as a, m.b as b, {loose} as loose,
                    {'(' + _check(kind, loose, 'm.hit') + ')'} as ok, length(regexp_replace(m.hit, '[^0-9]', '')) as n,
                    length(regexp_replace(m.hit, '[A-Za-z0-9]', '')) as signs, length(regexp_replace(m.hit, '[^A-Za-z]', '')) as chars, m.before as before, m.after as after))""")
    feature = f"""c -> struct(c.kind as kind, c.a as a, c.b as b, c.loose as loose, c.loose = 0 and c.ok as base, c.ok as ok,
        case when c.n < 4 then 0 when c.n < 9 then 1 when c.n < 13 then 2 when c.n < 16 then 3 when c.n < 20 then 4 else 5 end as digits,
        case when c.b - c.a < 12 then 0 when c.b - c.a < 20 then 1 when c.b - c.a < 40 then 2 else 3 end as size,
        int(least(c.signs, 2)) as apart, case when c.chars = 0 then 0 when c.chars < c.n then 1 else 2 end as letters, int(c.before rlike {_quoted(CUES)}) as cue,
        {_class("right(c.before, 1)")} as `left`, {_class("c.after")} as `right`)"""
    label = """c -> struct(c.*, case when not c.ok then 0 when c.cue = 1 or c.`left` <> 1 and c.`right` <> 1 then 1 else -1 end as label)"""
    names = ["kind", "a", "b", "loose", "base", "ok", *[f for f in FEATURES if f not in ("kind", "loose")]]
    label = label.replace("c.*", ", ".join(f"c.`{n}` as `{n}`" for n in names))
    return f"transform(transform(concat({', '.join(found)}), {feature}), {label})"


class Boosted:
    """Logistic boosting of small trees over a table of (feature values, label, count)."""

    def __init__(self, rows: list[tuple[dict[str, int], int, float]]):
        self.names = list(FEATURES)
        self.trees: list = []
        weight = [sum(n for _, y, n in rows if y == z) for z in (0, 1)]
        self.start = math.log((weight[1] + 1) / (weight[0] + 1))
        margin = [self.start] * len(rows)
        for _ in range(TREES if min(weight) > 0 else 0):
            p = [1 / (1 + math.exp(-m)) for m in margin]
            grad = [(y - q) * n for (_, y, n), q in zip(rows, p)]
            hess = [q * (1 - q) * n for (_, y, n), q in zip(rows, p)]
            tree = self._grow(rows, list(range(len(rows))), grad, hess, DEPTH)
            self.trees.append(tree)
            margin = [m + self._value(tree, x) for m, (x, _, _) in zip(margin, rows)]

    def _grow(self, rows, own, grad, hess, depth):
        g, h = sum(grad[i] for i in own), sum(hess[i] for i in own)
        leaf = RATE * g / (h + 1)
        if not depth:
            return leaf
        best = (1e-9, None)
        for f in self.names:
            for v in range(FEATURES[f]):
                for exact in (True, False) if f == "kind" else (False,):
                    yes = [i for i in own if (rows[i][0][f] == v if exact else rows[i][0][f] <= v)]
                    if 0 < len(yes) < len(own):
                        a, b = sum(grad[i] for i in yes), sum(hess[i] for i in yes)
                        gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                        if gain > best[0]:
                            best = (gain, (f, v, exact, yes))
        if best[1] is None:
            return leaf
        f, v, exact, yes = best[1]
        there = set(yes)
        return (f, v, exact, self._grow(rows, yes, grad, hess, depth - 1), self._grow(rows, [i for i in own if i not in there], grad, hess, depth - 1))

    def _value(self, tree, x):
        while isinstance(tree, tuple):
            f, v, exact, a, b = tree
            tree = a if (x[f] == v if exact else x[f] <= v) else b
        return tree

    def margin(self, x: dict[str, int]) -> float:
        return self.start + sum(self._value(t, x) for t in self.trees)

    def sql(self, of: str) -> str:
        """The margin as an expression over the struct ``of``."""

        def one(tree):
            if not isinstance(tree, tuple):
                return f"{tree!r}D"
            f, v, exact, a, b = tree
            return f"if({of}.`{f}` {'=' if exact else '<='} {v}, {one(a)}, {one(b)})"

        return " + ".join([f"{self.start!r}D", *map(one, self.trees)])


class Detector:
    """The fitted trees with a threshold for each kind, from rows (feature values, label, whether kept back, count)."""

    def __init__(self, table: list[tuple[dict[str, int], int, bool, float]]):
        self.model = Boosted([(x, y, n) for x, y, back, n in table if not back])
        self.least: dict[int, float] = {}
        for kind in range(len(KINDS)):
            scored = sorted(((self.model.margin(x), y, n) for x, y, back, n in table if back and x["kind"] == kind), reverse=True)
            right = every = 0.0
            if sum(n for _, _, n in scored) >= SEEN:
                self.least[kind] = math.inf
            for i, (m, y, n) in enumerate(scored):
                right, every = right + y * n, every + n
                lower = scored[i + 1][0] if i + 1 < len(scored) else -math.inf
                if lower < m and m > 0 and every >= SEEN and right >= PRECISION * every:
                    self.least[kind] = max(0.0, lower)  # down to the next one seen, but always likelier right than wrong

    def _chosen(self) -> str:
        """SQL: whether the trees take the candidate c."""
        cases = "".join(f" when c.kind = {k} then " + ("false" if m == math.inf else f"c.margin > {m!r}D") for k, m in self.least.items())
        return f"(case{cases} else c.label = 1 end)" if cases else "(c.label = 1)"

    def spans(self, found: str) -> str:
        """SQL: array of struct(kind, a, b, base) by kind and place, from candidates: the base spans, and what the trees add."""
        one = "struct<kind:int,a:bigint,b:bigint,base:boolean,margin:double>"
        scored = f"transform({found}, c -> struct(c.kind as kind, c.a as a, c.b as b, c.base as base, c.ok as ok, c.label as label, {self.model.sql('c')} as margin))"
        taken = f"transform(filter({scored}, c -> c.base or (c.ok and {self._chosen()})), c -> struct(c.kind as kind, c.a as a, c.b as b, c.base as base, c.margin as margin))"
        taken = f"array_sort({taken}, (x, y) -> case when x.a <> y.a then if(x.a < y.a, -1, 1) when x.b <> y.b then if(x.b > y.b, -1, 1) else x.kind - y.kind end)"
        # the end of all base spans before, and the start of the next base span
        before = _scan("every", "-1L", "bigint", "if(x.base, greatest(s, x.b), s)")
        behind = f"reverse({_scan('reverse(every)', '9223372036854775807L', 'bigint', 'if(x.base, x.a, s)')})"
        free = f"filter(zip_with(zip_with(every, {before}, (c, e) -> struct(c as c, e as e)), {behind}, (d, n) -> if(not d.c.base and d.e <= d.c.a and n >= d.c.b, d.c, null)), c -> c is not null)"
        # of two that overlap the likelier stays
        best = _scan("more", f"cast(null as {one})", one, "case when s is null or x.a >= s.b or x.margin > s.margin then x else s end")
        kept = _let("more", free, _let("held", best, "filter(held, (c, i) -> i + 1 = size(held) or more[i + 1].a >= c.b)"))
        whole = _let("every", taken, f"if(exists(every, c -> not c.base), concat(filter(every, c -> c.base), {kept}), every)")
        return f"""transform(array_sort({whole}, (x, y) -> case when x.kind <> y.kind then x.kind - y.kind when x.a < y.a then -1 when x.a > y.a then 1 else 0 end),
            c -> struct(c.kind as kind, c.a as a, c.b as b, c.base as base))"""


def fit(found: DataFrame, column: str) -> Detector:
    """From the candidates of all texts; the driver gets one row for each feature vector, label and part."""
    back = (F.pmod(F.xxhash64(column), F.lit(FOLDS)) == 0).alias("back")
    # the hash first: beside explode it would be taken again for each candidate
    seen = found.where(F.size(column) > 0).select(back, column).select("back", F.explode(column).alias("c")).where("c.label >= 0")
    rows = seen.groupBy(*(F.col(f"c.{f}").alias(f) for f in FEATURES), F.col("c.label").alias("label"), "back").count().collect()
    table = sorted((({f: int(r[f]) for f in FEATURES}, int(r["label"]), bool(r["back"]), float(r["count"])) for r in rows), key=str)
    return Detector(table)


def with_spans(docs: DataFrame, detector: Detector | None = None) -> tuple[DataFrame, str]:
    """docs with a column of spans more, and its name. Candidates are made once, and written."""
    name = fresh_name(docs, "pii_spans")
    found = materialize(docs.withColumn(name, F.expr(candidates("coalesce(text, '')"))), "candidates")
    detector = detector or fit(found, name)
    return found.withColumn(name, F.when(F.size(name) > 0, F.expr(detector.spans(f"`{name}`"))).otherwise(F.expr("cast(array() as array<struct<kind:int,a:bigint,b:bigint,base:boolean>>)"))), name


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["a"].cast("string"), s["b"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, base spans of each kind counted, the digest of all base spans, all spans, their number, and how many are secrets."""
    rows = docs.select("doc_id", "text")
    name = "pii_spans"
    found = materialize(rows.select("doc_id", F.expr(candidates("coalesce(text, '')")).alias(name)), "candidates")
    found = found.select("doc_id", F.expr(fit(found, name).spans(name)).alias(name))
    base = F.filter(name, lambda s: s["base"])
    counts = [F.expr(f"cast(size(filter({name}, s -> s.base and s.kind = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    secrets = F.expr(f"cast(size(filter({name}, s -> s.kind = {KINDS.index('secret')})) as long)").alias("n_secret")
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col(name)).alias("spans"), F.size(name).cast("long").alias("n_spans"), secrets)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text put as its kind in brackets; overlapping spans as the first one's. Null stays null."""
    found, name = with_spans(docs)
    span = "struct<kind:int,a:bigint,b:bigint>"
    by_place = f"array_sort(`{name}`, (x, y) -> case when x.a <> y.a then if(x.a < y.a, -1, 1) when x.b <> y.b then if(x.b > y.b, -1, 1) else x.kind - y.kind end)"
    cover = _scan("own", f"cast(null as {span})", span, "if(s is null or x.a >= s.b, struct(x.kind as kind, x.a as a, x.b as b), struct(s.kind as kind, s.a as a, greatest(s.b, x.b) as b))")

    def part(a: str, b: str) -> str:
        first, last = f"int(({a}) div {PIECE})", f"int((({b}) - 1) div {PIECE})"
        within = f"substring(pieces[{first}], int(({a}) % {PIECE} + 1), int(({b}) - ({a})))"
        across = f"concat(substring(pieces[{first}], int(({a}) % {PIECE} + 1)), array_join(slice(pieces, {first} + 2, {last} - {first} - 1), ''), substring(pieces[{last}], 1, int(({b}) - {last} * {PIECE}L)))"
        return f"(case when ({b}) <= ({a}) then '' when {first} = {last} then {within} else {across} end)"

    kinds = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    between = f"transform(held, (m, i) -> concat({part('if(i = 0, 0L, held[i - 1].b)', 'm.a')}, {kinds}[m.kind]))"
    tail = part("held[size(held) - 1].b", "bigint(length(text))")
    merged = _let("own", by_place, _let("marks", cover, "filter(marks, (m, i) -> i + 1 = size(marks) or own[i + 1].a >= m.b)"))
    out = _let("pieces", f"regexp_extract_all(text, '(?s).{{1,{PIECE}}}', 0)", _let("held", merged, f"concat(array_join({between}, ''), {tail})"))
    return found.withColumn("text", F.when(F.size(name) > 0, F.expr(out)).otherwise(F.col("text"))).drop(name)
