"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base finders (e-mail, IP, card, phone) are exact formats and always stay. Beside them
high-recall generators propose spans that may overlap; boosted trees score each candidate by its
format (length, digits, groups, check digit) and by the words around it; a threshold for each
kind, calibrated for precision on examples that the trees have not seen, selects spans. Trees
are trained on made examples with a fixed seed (no personal data is needed) and become one SQL
expression, so every text is read, searched, scored and redacted inside Spark's engine.

Places count code points, end exclusive. Defined results: null and empty texts have no spans
(redacting keeps null null); a null id passes through; equal rows are treated alike; other
columns pass through, whatever they are called (find() raises an error if one is named _base or
_spans, as its result would have two); an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import whole

_LOCAL = "A-Za-z0-9._%+-"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: Base kinds in order. Matches begin where no earlier one could: after a match or outside a run, so that long runs are read once.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Kinds that the generators propose.
GENERATORS = {
    "email": r"(?<!\S)[^\s@]{1,64}+@[^\s@]{1,255}+(?!\S)",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{2,6}(?:[ .-][0-9]{2,6})?(?![0-9A-Za-z-])",
    "id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?:AKIA[A-Z0-9]{12,}+|(?i:password|passwd|secret|token|api_?key) ?[=:] ?[\"']?[^\s\"']{6,}+[\"']?|[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
}
KINDS = [*BASE, *(k for k in GENERATORS if k not in BASE)]
#: Characters of context on the left, and words there that speak for personal data or against it.
CONTEXT = 32
FOR = r"(?i)(?:call|phone|tel|mobile|fax|card|visa|credit|mail|contact|write to|reach|host|addr|server|ssn|social|iban|account|bank|key|token|secret|password|login|passport)"
AGAINST = r"(?i)(?:version|release|commit|sha|md5|build|page|isbn|order|figure|table|chapter|serial|section|revision|checksum|digest|http)"
FEATURES = ["type", "chars", "digits", "letters", "separators", "groups", "luhn", "at", "speaks_for", "speaks_against", "distinct", "upper"]
ROUNDS, RATE, EXAMPLES, PRECISION = 30, 0.3, 3000, 0.99


def _matches(text: Column, pattern: str, gate: Column | None) -> tuple[Column, Column]:
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gap = F.split(text, pattern, -1)
    if gate is None:
        return hit, gap
    none = F.array().cast("array<string>")
    return F.when(gate, hit).otherwise(none), F.when(gate, gap).otherwise(none)


def _placed(hits: Column, gaps: Column) -> Column:
    """(start, end, value) of each match: gaps and matches alternate, so lengths add up to places."""
    kind = "struct<at:int,found:array<struct<start:int,end:int,value:string>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found")).cast(kind)
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda v, g: F.struct(v.alias("v"), F.length(g).alias("g")))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["g"]
        b = a + F.length(x["v"])
        return F.struct(b.alias("at"), F.concat(acc["found"], F.array(F.struct(a.alias("start"), b.alias("end"), x["v"].alias("value")))).alias("found")).cast(kind)

    return F.aggregate(pairs, start, step)["found"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)
    n = F.length(d)

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x["value"]))
    if kind == "ip":
        return x["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return (n >= 14) & (n <= 19) & _luhn(x["value"])
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _features(text: Column, kind: Column, x: Column) -> dict[str, Column]:
    v = x["value"]
    count = lambda keep: F.length(F.regexp_replace(v, f"[^{keep}]", ""))
    before = F.substring(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT)))
    return {
        "type": kind,
        "chars": F.length(v),
        "digits": count("0-9"),
        "letters": count("A-Za-z"),
        "separators": count(r" ().\-:"),
        "groups": F.size(F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0))),
        "luhn": _luhn(v).cast("int"),
        "at": F.length(F.regexp_replace(v, "[^@]", "")),
        "speaks_for": (before.rlike(FOR) | v.rlike(FOR)).cast("int"),
        "speaks_against": before.rlike(AGAINST).cast("int"),
        "distinct": F.size(F.array_distinct(F.split(_digits(v), ""))),
        "upper": count("A-Z"),
    }


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, _base, _proposed): row holds the columns of docs, the others are arrays of (start, kind number, end, kind, value[, features])."""
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole(text_col).alias("text"))
    text = F.col("text")
    some_digits = text.rlike("[0-9]")
    gates = {"email": F.instr(text, "@") > 0, "phone": F.instr(text, "+") > 0}
    steps = {f"_h_{k}": _matches(text, p, gates.get(k, some_digits)) for k, p in BASE.items()}
    steps |= {f"_g_{k}": _matches(text, p, gates["email"] if k == "email" else None if k == "secret" else some_digits) for k, p in GENERATORS.items()}
    out = docs.withColumns({**{n: h for n, (h, _) in steps.items()}, **{f"{n}_gap": g for n, (_, g) in steps.items()}})
    out = out.withColumns({f"{n}_at": F.when(F.size(n) > 0, _placed(F.col(n), F.col(f"{n}_gap"))).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>")) for n in steps})
    row = lambda k, x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(k)).alias("n"), x["end"].alias("end"), F.lit(k).alias("kind"))
    base = F.concat(*[F.transform(F.filter(f"_h_{k}_at", partial(_valid, k)), partial(row, k)) for k in BASE])
    described = lambda k, x: F.struct(*[row(k, x)[f].alias(f) for f in ("start", "n", "end", "kind")], *[c.cast("double").alias(f) for f, c in _features(text, F.lit(KINDS.index(k)), x).items()])
    some = F.concat(*[F.transform(f"_g_{k}_at", partial(described, k)) for k in GENERATORS])
    return out.withColumns({"_base": F.array_sort(base), "_proposed": some}).select("row", "_base", "_proposed")


@dataclass(frozen=True)
class Trees:
    """Trees of depth two: (feature, cut, (feature, cut) on each side, four leaves); score = bias + sum of leaves."""

    bias: float
    trees: list[tuple[int, float, tuple[int, float], tuple[int, float], tuple[float, float, float, float]]]
    cuts: dict[str, float]

    def score(self, x: Column) -> Column:
        f = lambda i: x[FEATURES[i]]
        parts = [F.when(f(a) <= c, F.when(f(l[0]) <= l[1], v[0]).otherwise(v[1])).otherwise(F.when(f(r[0]) <= r[1], v[2]).otherwise(v[3])) for a, c, l, r, v in self.trees]
        return reduce(lambda p, q: p + q, parts, F.lit(self.bias))

    def cut(self, x: Column) -> Column:
        out = F.lit(float("inf"))
        for kind, c in self.cuts.items():
            out = F.when(x["kind"] == kind, F.lit(c)).otherwise(out)
        return out


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    best = (0.0, 0, float(x[:, 0].max()) if len(x) else 0.0)
    for j in range(x.shape[1]):
        for c in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)))[:-1] if len(x) else ():
            left = x[:, j] <= c
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
            best = max(best, (float(gain), j, float(c)))
    return best[1], best[2]


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list]:
    """Gradient boosting of depth-two trees on the logistic loss, with Newton leaves."""
    bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z, trees = np.full(len(y), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        a, c = _split(x, g, h)
        left = x[:, a] <= c
        sides = [_split(x[m], g[m], h[m]) for m in (left, ~left)]
        leaves = []
        for m, (j, d) in zip((left, ~left), sides, strict=True):
            for low in (m & (x[:, j] <= d), m & (x[:, j] > d)):
                v = rate * float(g[low].sum() / (h[low].sum() + 1))
                z[low] += v
                leaves.append(v)
        trees.append((a, c, sides[0], sides[1], tuple(leaves)))
    return bias, trees


def _examples(n: int, seed: int = 7) -> list[tuple[str, int]]:
    """Made texts with one candidate each, and whether it is personal data."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choices("0123456789", k=k))
    w = lambda: "".join(r.choices("abcdefghilmnoprstu", k=r.randint(3, 9)))
    hexes = lambda k: "".join(r.choices("0123456789abcdef", k=k))

    def luhn(k: int) -> str:
        s = r.choice("3456") + d(k - 2)
        total = sum(int(c) if i % 2 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(s)))
        return s + str(-total % 10)

    def spoilt(s: str) -> str:
        return s[:-1] + str((int(s[-1]) + r.randint(1, 9)) % 10)

    def iban() -> str:
        return "".join(r.choices("ABDEFGIT", k=2)) + d(2) + " ".join(["", *(d(4) for _ in range(r.randint(3, 5)))])

    def bare() -> str:
        s = hexes(r.choice([32, 40, 64, 96]))
        return s.upper() if r.random() < 0.3 else s

    def secret() -> str:
        q = r.choice(["", '"', "'"])
        keyed = r.choice(["password", "passwd", "secret", "token", "TOKEN", "api_key"]) + r.choice(["=", ": ", " = "]) + q
        return r.choice(["AKIA" + "".join(r.choices("ABCDEFGH234567", k=16)), f"{keyed}{hexes(r.choice([18, 24]))}{q}", f"{keyed}{bare()}{q}", bare()])

    say = {"email": ["mail", "contact", "write to"], "ip": ["host", "server", "addr"], "card": ["card", "visa", "credit"], "phone": ["call", "phone", "tel", "mobile"], "id": ["ssn", "social"], "iban": ["iban", "bank account"], "secret": ["key", "token", "login", "secret", "password"]}
    other = ["version", "commit", "order", "page", "isbn", "checksum", "build", "serial"]
    good = {"email": lambda: f"{w()}@{w()}", "ip": lambda: ":".join(hexes(4) for _ in range(8)), "card": lambda: luhn(r.choice([13, 15, 16])), "phone": lambda: f"({d(3)}) {d(3)}-{d(4)}" if r.random() < 0.5 else f"{d(3)}-{d(3)}-{d(4)}", "id": lambda: f"{d(3)}-{d(2)}-{d(4)}", "iban": iban, "secret": secret}
    bad = {"email": lambda: f"@{w()}@{w()}"[1:], "ip": lambda: ":".join(d(2) for _ in range(5)), "card": lambda: spoilt(luhn(r.choice([13, 15, 16]))), "phone": lambda: r.choice([f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(2)} {d(2)} {d(2)}"]), "id": lambda: f"{d(3)}-{d(2)}-{d(4)}", "iban": lambda: "AB12 " + " ".join("".join(r.choices("ABCDEFGHIJKLMNOP", k=4)) for _ in range(4)), "secret": bare}
    out = []
    for k in range(n):
        kind, y = KINDS[k % len(KINDS)], int(r.random() < 0.5)
        lead = r.choice(say[kind]) if r.random() < (0.8 if y else 0.1) else r.choice(other) if r.random() < (0.02 if y else 0.6) else w()
        value = (good if y else bad)[kind]()
        if kind in ("email", "id") or (kind == "secret" and not re.search("[=:]|AKIA", value)):
            y = int(lead in say[kind])  # nothing but the words around them tells these
        out.append((f"{w()} {w()} {lead} {value} {w()}.", y))
    return out


def train(spark: SparkSession, examples: int = EXAMPLES, precision: float = PRECISION) -> Trees:
    """Trees and thresholds from made examples: half to learn, half to calibrate."""
    made = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(_examples(examples))], "i int, text string, y int").coalesce(1)
    rows = candidates(made).select("row.i", "row.y", F.explode("_proposed").alias("x")).select("i", "y", "x.*").orderBy("i", "start", "n").collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    y = np.array([r["y"] * (r["n"] == r["i"] % len(KINDS)) for r in rows], float)  # an example speaks for its own kind alone
    half = np.array([r["i"] % 2 == 0 for r in rows])
    bias, trees = boost(x[half], y[half])
    z = np.full(len(y), bias)
    for a, c, (la, lc), (ra, rc), v in trees:
        z += np.where(x[:, a] <= c, np.where(x[:, la] <= lc, v[0], v[1]), np.where(x[:, ra] <= rc, v[2], v[3]))
    cuts = {}
    for kind in GENERATORS:
        at = ~half & (x[:, 0] == KINDS.index(kind))
        for c in np.unique(z[at]):
            if y[at & (z >= c)].mean() >= precision:
                cuts[kind] = max(float(c), 0.0)
                break
        if kind not in cuts:
            raise ValueError(f"no threshold gives candidates of kind {kind} a precision of {precision}")
    return Trees(bias, trees, cuts)


def find(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """docs with _base and _spans: arrays of (start, kind number, end, kind), sorted; _spans holds _base and what the trees select beside it."""
    if {"_base", "_spans"} & set(docs.columns):
        raise ValueError("_base and _spans are columns of the input")
    return _found(docs, trees, text_col).select("row.*", "_base", "_spans")


def _found(docs: DataFrame, trees: Trees, text_col: str) -> DataFrame:
    """(row, _base, _spans)."""
    out = candidates(docs, text_col)
    apart = lambda a, b: (a["end"] <= b["start"]) | (b["end"] <= a["start"])
    scored = F.transform("_proposed", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), x["end"].alias("end"), x["kind"].alias("kind"), trees.score(x).alias("score"), trees.cut(x).alias("cut")))
    out = out.withColumn("_scored", F.when(F.size("_proposed") > 0, F.filter(scored, lambda x: x["score"] >= x["cut"])))
    free = F.filter("_scored", lambda x: F.forall("_base", lambda b: apart(x, b)) & F.forall("_scored", lambda o: apart(x, o) | (o["score"] < x["score"]) | ((o["score"] == x["score"]) & (F.struct(o["start"], o["n"], o["end"]) >= F.struct(x["start"], x["n"], x["end"])))))
    added = F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), x["end"].alias("end"), x["kind"].alias("kind")))
    every = F.when(F.size("_scored") > 0, F.array_sort(F.concat("_base", added))).otherwise(F.col("_base"))
    return out.withColumn("_spans", every).drop("_proposed", "_scored")


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; spans that overlap become one."""
    kind = "struct<at:int,out:string>"
    text = F.col("row")[text_col]

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        kept = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], kept, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out")).cast(kind)

    made = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(kind), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    out = _found(docs, trees, text_col)
    return out.select(*[(F.when(F.size("_spans") > 0, made).otherwise(text) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
