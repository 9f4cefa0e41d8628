"""Personal data: base rules, and candidates judged by boosted trees.

*Base* spans are exact: leftmost non-overlapping matches per kind that pass the
kind's check.  On top, looser generators propose overlapping candidates (spaced
or bracketed e-mail addresses, numbers with other separators, cards, phones and
ips from any digit group on inside longer digit runs, phones without a plus).  Boosted trees over format and
context features score them; a threshold per kind, calibrated on held-out
candidates, selects, and an exact check follows: a candidate whose plain spelling
would not be a base span of its kind is dropped.  Candidates that touch a base span add
nothing; of overlapping accepted ones the best stays, then the best of those that
don't overlap it, and so on.

The trees are fitted on all candidates: those that would be base spans if they
stood alone and were spelled the plain way, in their own and in loosened spellings,
against the others; equal feature vectors count as one row with their number.
Those of a quarter of the documents are held out, for the thresholds.  Spelled the plain way: (at), [dot] and the like, and an @ or
dot with a blank on both sides, are the plain sign; a card is its digits; a phone
that begins with 00 begins with a plus.  Nothing in its digits tells a phone
without either from other numbers, so a bracketed group or a word like "call"
before it must.  Commas are not mapped to dots: four numbers with commas are a list.
A fitted ensemble becomes one arithmetic expression over CASEs.

Everything on the way from text to spans is a column expression within its
row: no Python on executors, no shuffle of texts, no grouping of spans.

Defined results: null and empty texts have no spans; without enough candidates
of both classes no span is added; positions are code points, ends exclusive;
repeated rows come back as often as they occur; empty tables give empty
results; further columns are ignored (``redacted`` keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "ip", "card", "phone")
KIND_WEIGHT = 4_000        # candidates that a kind weighs as in the trees, however many more it has
PARTITION_ROWS = 50_000    # feature vectors of a partition, about
TREES, DEPTH = 10, 3
PRECISION = 0.98           # that a threshold must reach on held-out candidates
NEVER = 2.0                # threshold of a kind that nothing can be added to

# Base patterns.  Same matches as the plain forms, but linear on any text:
# quantifiers that need not give back are possessive, and a match may only
# start where a run starts (or the match before ended).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"

# Generators of candidates: e-mail addresses by a pattern; numbers from runs of
# digit groups, in which every group starts candidates, one for each of the
# patterns that match there (each has one place to end).
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++"
GROUP = r"\+?\(?[0-9]++"
RUN = GROUP + r"(?:[\x20().,/-]{1,3}+[0-9]++)*+"
LOOSE = {
    "ip": (r"^[0-9]{1,3}(?:\x20?[.,]\x20?[0-9]{1,3}){3}(?![0-9])",),
    "card": tuple(rf"^[0-9](?:[\x20./-]?[0-9]){{{n - 1}}}(?![0-9])" for n in range(12, 20)),
    "phone": tuple(rf"^(?:\+|00)?(?:\(?[0-9]{{1,4}}\)?[\x20./-]){{{n}}}[0-9]{{3,8}}(?![0-9])" for n in range(1, 5)),
}
TAIL = 48                  # characters: more than any of LOOSE can match and look at
BEFORE, AFTER = 24, 8      # characters around a candidate

_SPAN = "array<struct<k:int,s:int,e:int,t:string>>"


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(t: Column) -> Column:
    """Whether the digits of ``t`` pass the Luhn check."""
    d = F.reverse(_digits(t))

    def add(acc, i):
        v = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(v >= 5, v * 2 - 9).otherwise(v * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(v)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add)
    return (F.length(d) > 0) & (total % 10 == 0)


def _valid(kind: str, t: Column) -> Column:
    n = F.length(_digits(t))
    return {"email": lambda: F.lit(True), "ip": lambda: t.rlike(OCTETS),
            "card": lambda: n.between(13, 19) & luhn(t), "phone": lambda: n.between(9, 15)}[kind]()


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """All matches with their places: gaps between matches give the positions."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), lambda x: x["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        one = F.struct(F.lit(kind).alias("k"), s.alias("s"), e.alias("e"), x["m"].alias("t"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def numbers_of(text: Column) -> Column:
    """Candidates of all kinds but e-mail, with their surroundings: within each run of digit groups, from
    every group on, all that LOOSE allows.  They overlap."""
    def starts(r):
        # one piece of the text for each group: cutting from a long text takes its length
        def piece(g):
            at = F.greatest(r["s"] + g["s"] - BEFORE, F.lit(0))
            return F.struct(at.alias("at"), (r["s"] + g["s"] - at).alias("p"), (r["s"] + g["e"] - F.length(_digits(g["t"])) - at).alias("d"),
                            F.substring(text, at + 1, F.lit(BEFORE + TAIL + AFTER)).alias("text"))
        return F.transform(spans_of(r["t"], GROUP, 0), piece)

    def tails(x):
        # digits: without the plus or bracket before them
        return F.struct(*[x[c] for c in ("at", "p", "d", "text")], F.substring(x["text"], x["d"] + 1, F.lit(TAIL)).alias("digits"),
                        F.substring(x["text"], x["p"] + 1, F.lit(TAIL)).alias("phone"))

    def matches(x):
        some = F.array(*[F.struct(F.lit(KINDS.index(k)).alias("k"), (x["p"] if k == "phone" else x["d"]).alias("s"),
                                  F.regexp_extract(x["phone" if k == "phone" else "digits"], p, 0).alias("t"))
                         for k, patterns in LOOSE.items() for p in patterns])

        def placed(m):
            before = F.greatest(m["s"] - BEFORE, F.lit(0))
            s = x["at"] + m["s"]
            return F.struct(m["k"].alias("k"), s.alias("s"), (s + F.length(m["t"])).alias("e"), m["t"].alias("t"),
                            F.substring(x["text"], before + 1, m["s"] - before).alias("before"),
                            F.substring(x["text"], m["s"] + F.length(m["t"]) + 1, F.lit(AFTER)).alias("after"))
        return F.transform(F.filter(some, lambda m: m["t"] != ""), placed)

    runs = F.filter(spans_of(text, RUN, 0), lambda r: F.length(r["t"]) >= 5)
    return F.flatten(F.transform(F.transform(F.flatten(F.transform(runs, starts)), tails), matches))


def _checked(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: _valid(kind, x["t"]))


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPAN})")


def found(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """Columns ``keep`` (names, or a column that becomes ``__row``), base spans,
    and candidates with their surroundings."""
    named = [c if isinstance(c, str) else "__row" for c in keep]
    d = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    t = F.col("__t")
    digits = t.rlike(r"[0-9][\x20().,/0-9-]{5,}[0-9]")
    gates = {"email": t.contains("@"), "ip": digits, "card": digits, "phone": t.rlike(r"\+[0-9]")}
    base = [F.when(gates[k], _checked(spans_of(t, p, i), k)).otherwise(_none())
            for i, (k, p) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE)))]
    mail = t.contains("@") | t.contains("(at)") | t.contains("[at]")

    def around(x):
        before = F.greatest(x["s"] - BEFORE, F.lit(0))
        return F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"),
                        F.substring(t, before + 1, x["s"] - before).alias("before"),
                        F.substring(t, x["e"] + 1, F.lit(AFTER)).alias("after"))

    no = F.expr(f"cast(array() as {_SPAN[:-2]},before:string,after:string>>)")
    loose = [F.when(mail, F.transform(spans_of(t, LOOSE_EMAIL, 0), around)).otherwise(no), F.when(digits, numbers_of(t)).otherwise(no)]
    return d.select(*named, F.concat(*base).alias("base"), F.concat(*loose).alias("candidates"))


def _features(c: Column) -> dict[str, Column]:
    """Format and context features of a candidate."""
    t, low = c["t"], F.lower(c["before"])
    n = F.length(_digits(t))
    groups = F.split(F.regexp_replace(t, r"^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", ""), "[^0-9A-Za-z]+")
    num = {f"is_{k}": c["k"] == i for i, k in enumerate(KINDS)}
    num |= {"length": F.length(t), "digits": n, "groups": F.size(groups),
            "first": F.length(groups[0]), "last": F.length(F.element_at(groups, -1)),
            "letters": F.length(F.regexp_replace(t, "[^A-Za-z]", "")),
            "dots": F.length(F.regexp_replace(t, r"[^.]", "")),
            "luhn": (c["k"] == 2) & luhn(t),
            "octets": F.regexp_replace(t, r"[^0-9]+", ".").rlike(OCTETS),
            "word_before": c["before"].rlike(r"[\p{L}\p{N}_.#/-]$"), "word_after": c["after"].rlike(r"^[\p{L}\p{N}_/#-]"),
            "mail": low.rlike(r"mail|@|contact|schreib|correo"), "call": low.rlike(CALL),
            "pay": low.rlike(r"card|karte|carte|tarjeta|visa|pay"), "host": low.rlike(r"\bip|host|server|addr|from")}
    return {k: v.cast("double") for k, v in num.items()}


FEATURES = tuple(f"is_{k}" for k in KINDS) + ("length", "digits", "groups", "first", "last", "letters", "dots", "luhn", "octets",
                                              "word_before", "word_after", "mail", "call", "pay", "host")


def _overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


CALL = r"tel|phone|call|fax|mobil|llam"


def _plain(c: Column) -> dict[str, Column]:
    """By kind, the text of a candidate in the spelling of the base rules."""
    t = c["t"]
    signs = F.regexp_replace(F.regexp_replace(t, r"\x20?[(\[]at[)\]]\x20?|\x20@\x20", "@"), r"\x20?[(\[]dot[)\]]\x20?|\x20\.\x20", ".")
    marked = F.regexp_replace(F.regexp_replace(t, "^00", "+"), "/", "-")
    called = t.rlike(r"\([0-9]+\)") | F.lower(c["before"]).rlike(rf"(?:{CALL})[a-z]*[\x20:.]*$")
    phone = F.when(marked.startswith("+") | t.rlike(OCTETS) | ~called, marked) \
        .otherwise(F.concat(F.lit("+"), F.regexp_replace(marked, r"^\(", "")))
    return {"email": signs, "ip": F.regexp_replace(t, r"\x20\.\x20", "."), "card": _digits(t), "phone": phone}


def _label(c: Column) -> Column:
    y, plain = F.lit(False), _plain(c)
    for i, (k, p) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE))):
        y = y | ((c["k"] == i) & plain[k].rlike(f"^(?:{p})$") & _valid(k, plain[k]))
    return y


def with_features(d: DataFrame, labelled: bool = True) -> DataFrame:
    """Candidates as structs k, s, e, t, y (if ``labelled``), FEATURES.

    y, the label: standing alone in plain spelling, the candidate would be a base span.
    """
    def one(c):
        y = _label(c) if labelled else F.lit(False)
        return F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), c["t"].alias("t"),
                        c["before"].alias("before"), c["after"].alias("after"), y.alias("y"),
                        *[v.alias(n) for n, v in _features(c).items()])

    return d.withColumn("candidates", F.transform("candidates", one))


def _loosened(c: Column) -> Column:
    """Another spelling of a true span, for training."""
    t = c["t"]
    return F.when(c["k"] == 0, F.regexp_replace(F.regexp_replace(t, "@", " (at) "), r"\.(?=[A-Za-z0-9-]+$)", " (dot) ")) \
        .when(c["k"] == 1, F.regexp_replace(t, r"\.", " . ")) \
        .when(c["k"] == 2, F.regexp_replace(_digits(t), r"([0-9]{4})(?=[0-9])", "$1.")) \
        .otherwise(F.regexp_replace(t, r"^\+", ""))


class Trees:
    """Fitted ensemble and thresholds, as expressions."""

    def __init__(self, trees: list | None = None, thresholds: dict | None = None):
        self.trees, self.thresholds = trees or [], thresholds or {}

    def score(self, c: Column) -> Column:
        """Probability of a candidate (a struct with FEATURES)."""
        def walk(node):
            if isinstance(node, float):
                return F.lit(node)
            f, cut, left, right = node
            return F.when(c[FEATURES[f]] <= cut, walk(left)).otherwise(walk(right))
        if not self.trees:
            return F.lit(0.0)
        total = sum((F.lit(w) * walk(t) for w, t in self.trees[1:]), F.lit(self.trees[0][0]) * walk(self.trees[0][1]))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * total))

    def threshold(self, k: Column) -> Column:
        out = F.lit(NEVER)
        for i, v in self.thresholds.items():
            out = F.when(k == i, F.lit(v)).otherwise(out)
        return out


def _nested(node):
    """A Spark ML tree as nested (feature, threshold, left, right)."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    s = node.split()
    return int(s.featureIndex()), float(s.threshold()), _nested(node.leftChild()), _nested(node.rightChild())


def vectors(d: DataFrame) -> DataFrame:
    """held, y, k, FEATURES and their number ``n``, over all candidates of found(...) rows with doc_id,
    but those that touch a base span and aren't one (they are never judged); true ones a second time, loosened.
    """
    c, again = F.col("c"), ("k", "s", "e", "t", "before", "after")
    rows = d.select("doc_id", "base", F.explode("candidates").alias("c"))
    rows = rows.where(~F.exists("base", lambda b: _overlap(b, c)) | F.exists("base", lambda b: (b["k"] == c["k"]) & (b["s"] == c["s"]) & (b["e"] == c["e"])))
    held = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(4)) == 0
    rows = rows.select(held.alias("held"), _label(c).alias("y"), "c")
    other = F.struct(*[(_loosened(c) if n == "t" else c[n]).alias(n) for n in again])
    rows = rows.select("held", "y", F.explode(F.when(F.col("y"), F.array(F.struct(*[c[n].alias(n) for n in again]), other))
                                              .otherwise(F.array(F.struct(*[c[n].alias(n) for n in again])))).alias("c"))
    rows = rows.select("held", "y", c["k"].alias("k"), *[v.alias(n) for n, v in _features(c).items()])
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def fit(d: DataFrame, precision: float = PRECISION) -> Trees:
    """Trees and thresholds from found(...) rows with doc_id: from all their ``vectors``.

    (Spark's learner looks at some 10,000 of the vectors for the places of its bins; the
    splits are chosen on all.)  A quarter of the documents is held out for the thresholds.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    every = staged(vectors(d), "pii-vectors")
    train = every.where("not held")
    sums = train.groupBy("k", "y").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    n = {y: sum(r.n for r in sums if r.y == y) for y in (True, False)}
    if n[True] < 10 or n[False] < 10:
        return Trees()
    weight = F.col("n").cast("double")
    for k in range(len(KINDS)):
        of = sum(r.n for r in sums if r.k == k)
        weight = F.when(F.col("k") == k, F.col("n") * F.lit(min(1.0, KIND_WEIGHT / max(of, 1)))).otherwise(weight)
    # partitions and their order follow from the rows, not from how they were stored
    data = train.withColumn("weight", weight).withColumn("label", F.col("y").cast("double"))
    data = data.repartition(max(1, math.ceil(sum(r.rows for r in sums) / PARTITION_ROWS)), *FEATURES).sortWithinPartitions("label", *FEATURES)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(data).select("x", "label", "weight")
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(data)
    trees = [(float(w), _nested(t._java_obj.rootNode())) for t, w in zip(model.trees, model.treeWeights)]
    fitted = Trees(trees)
    # calibration: the lowest score above which the held-out precision holds
    c = F.struct(*FEATURES)
    grid = (every.where("held").withColumn("bin", F.floor(fitted.score(c) * 100))
            .groupBy("k", "bin").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y"), F.col("n")).otherwise(F.lit(0))).alias("p")).collect())
    for k in range(len(KINDS)):
        hits = total = 0
        for r in sorted((r for r in grid if r.k == k), key=lambda r: -r.bin):
            hits, total = hits + r.p, total + r.n
            if hits >= precision * total and r.bin >= 50:
                fitted.thresholds[k] = r.bin / 100
    return fitted


def judged(d: DataFrame, trees: Trees) -> DataFrame:
    """found(...) rows with ``spans``: the base ones and the accepted ones."""
    base = F.col("base")
    if not trees.thresholds:
        return d.withColumn("spans", F.array_sort(base)).drop("candidates")
    fresh = F.filter("candidates", lambda c: ~F.exists(base, lambda b: _overlap(b, c)))
    d = with_features(d.withColumn("candidates", fresh))
    # exact check: what would not be a base span in plain spelling (a card that fails Luhn, an ip with a part over 255) never is one
    rated = F.transform(F.filter("candidates", lambda c: c["y"]), lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), c["t"].alias("t"),
                                                         trees.score(c).alias("p")))
    d = d.withColumn("rated", F.filter(rated, lambda c: c["p"] >= trees.threshold(c["k"])))
    # by score, then by place, length and kind: a strict order
    order = F.array_sort(F.transform("rated", lambda c: F.struct((-c["p"]).alias("p"), c["s"].alias("s"), (-c["e"]).alias("e"), c["k"].alias("k"), c["t"].alias("t"))))

    def step(acc, x):
        c = F.struct(x["k"].alias("k"), x["s"].alias("s"), (-x["e"]).alias("e"), x["t"].alias("t"))
        return F.when(F.exists(acc, lambda o: _overlap(o, c)), acc).otherwise(F.concat(acc, F.array(c)))

    added = F.aggregate(order, _none(), step)
    return d.withColumn("spans", F.array_sort(F.concat(base, added))).drop("candidates", "rated")


def count_of(spans: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, by kind and start, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def detect(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """doc_id, base and spans of every row (fits the trees if none are given)."""
    d = staged(found(docs), "pii-found")
    return judged(d, trees if trees is not None else fit(d))


def redacted(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """The documents with every span replaced by its kind, in brackets.

    Overlapping spans (of several kinds) are replaced as one, named by the
    first.  ``n_chars``, where there is such a column, follows the text.
    """
    if trees is None:
        trees = fit(staged(found(docs), "pii-found"))
    x = judged(found(docs, keep=(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),)), trees)
    names = F.array(*map(F.lit, KINDS))
    text = F.col("__row.text").cast("string")
    by_place = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        before = F.substring(text, acc["at"] + 1, x["s"] - acc["at"])
        new = F.struct(x["e"].alias("at"), F.concat(acc["out"], before, F.lit("["), F.element_at(names, x["k"] + 1), F.lit("]")).alias("out"))
        inside = F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))
        return F.when((x["s"] < acc["at"]), inside).otherwise(new)

    done = F.aggregate(by_place, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))
    hit = F.size("spans") > 0
    x = x.withColumn("__new", F.when(hit, done).otherwise(text))
    kinds = dict(docs.dtypes)

    def column(c):
        old = F.col(f"__row.`{c}`")
        if c == "text":
            return F.col("__new").cast(kinds[c]).alias(c)
        if c == "n_chars" and kinds[c] in ("int", "bigint"):
            return F.when(hit, F.length("__new").cast(kinds[c])).otherwise(old).alias(c)
        return old.alias(c)

    return x.select(*[column(c) for c in docs.columns])
