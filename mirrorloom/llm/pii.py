"""Personal data by candidate gradient boosting.

Base spans are exact patterns with their checks (Luhn, octets, digit counts); they always stay.  They are leftmost and
greedy, so a run of digits that swallows a neighbour fails whole.  High-recall generators therefore propose overlapping
candidates: every sequence of neighbouring digit groups inside a run that has the shape of a card, phone number or
address and passes its check, e-mail addresses with spelt-out signs, and long strings of letters and digits that may be
secrets (keys, tokens).  Boosted trees score a candidate by its format and context.

No table labels personal data, so labels come from where the truth is plain, and no feature repeats the label's test:

* Numbers and addresses: of the candidates that overlap base spans, those that are one are positive and all others
  negative.  What the model then decides are the candidates that overlap none.
* Secrets: a candidate that is assigned to a name like ``token`` or ``password`` is positive, any other negative; the
  features see its characters and length, neither the name nor the quotes that come with one.

Per kind the threshold is the lowest at which held-out labelled candidates reach ``PRECISION``, smoothed by one success
and one failure.  An accepted candidate is added if it beats every accepted one that overlaps it and touches no base span.

Texts are read in one narrow pass.  Spans and candidates go on as rows: they meet by (document, stretch of text), so a
text with a hundred thousand numbers costs as many rows and no list is walked for each.  The features of a candidate are
one integer of ``CODE_BITS`` bits, so learning is an aggregate to at most 2^CODE_BITS rows per kind; the trees become one
CASE expression.  All of it is DataFrame code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, keyed, stored, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
#: Kinds of added spans: those of the base, and secrets.
ALL_KINDS = [*KINDS, "secret"]
#: The base patterns.  Possessive forms and look-behinds match the same spans without backtracking over long runs.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must be in a text before a pattern is tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}
#: Generators: runs of digit groups, and e-mail addresses with spelt-out signs.
RUN = r"\+?+\(?+[0-9]++(?:[\x20().-]{1,2}+[0-9]++)*+"
SPELT = rf"(?<![{LOCAL}])[{LOCAL}]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]++)++"
#: Strings that may be secrets, the character before them, and the names that they are assigned to.
SECRET = r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])(?=[0-9_/+=-]*+[A-Za-z])[A-Za-z0-9_/+=-]{16,}+"
ASSIGNED = r"(?i)(?:token|secret|key|passw(?:or)?d|pwd|credential)[\x20]{0,2}[:=][\x20]{0,2}[\x22']?$"
LONGEST = 19  # digits, and so groups, in a candidate
#: Cue words, in front of a candidate within 24 characters.
CUES = r"(?i)(?:mail|contact|write|tel|phone|call|fon|mobil|card|visa|master|amex|carte|karte|tarjeta|ip|host|addr|server)\b?[^\n]{0,12}$"
#: A match: its place, its text, and up to 32 characters before and 2 after it that belong to no other match.
SPAN = "array<struct<s:int,e:int,m:string,b:string,a:string>>"
#: Bits of each feature in a candidate's code, lowest first.
FEATURES = {"hex": 1, "digits": 4, "groups": 3, "before": 2, "after": 2, "cue": 1, "plus": 1, "marks": 2}
CODE_BITS = sum(FEATURES.values())
ROUNDS, SHRINK, PRECISION = 12, 0.4, 0.95
#: Characters of a stretch, and matches that are placed together.
STRETCH, TOGETHER = 64, 256


def spans_of(text: Column, pattern: str, needs: str) -> Column:
    """All leftmost non-overlapping matches with their places in code points.

    Places are running sums.  They are taken within groups of ``TOGETHER`` matches, then over the groups, so the time
    is linear for any number of matches that fits a row.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    n = F.size(found)
    steps = F.zip_with(F.zip_with(found, F.slice(gaps, F.lit(1), n), lambda m, g: F.struct(m.alias("m"), g.alias("g"))), F.slice(gaps, F.lit(2), n), lambda x, g: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("n"), x["m"].alias("m"), F.right(x["g"], F.lit(32)).alias("b"), F.left(g, F.lit(2)).alias("a")))
    empty = F.array().cast(SPAN)

    def walk(group: Column) -> Column:
        return F.aggregate(
            group, F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda a, z: F.struct((a["at"] + z["g"] + z["n"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + z["g"]).alias("s"), (a["at"] + z["g"] + z["n"]).alias("e"), z["m"].alias("m"), z["b"].alias("b"), z["a"].alias("a")))).alias("out")),
        )

    def place(groups: Column) -> Column:
        starts = F.aggregate(groups, F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + w["at"])))
        moved = F.zip_with(groups, F.slice(starts, F.lit(1), F.size(groups)), lambda w, by: F.transform(w["out"], lambda x: F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a"))))
        return F.flatten(moved)

    def grouped(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / TOGETHER).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: walk(F.slice(all_, i * TOGETHER + 1, F.lit(TOGETHER))))
        return F.flatten(F.transform(F.array(cut), place))  # the arrays of one bind their value, so that it is made once

    return F.when(text.rlike(needs), F.flatten(F.transform(F.array(steps), grouped))).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check sum of a string of digits is divisible by ten."""
    rev = F.split(F.reverse(digits), "")
    doubled = F.transform(rev, lambda d, i: F.when(d == "", 0).when(i % 2 == 0, F.ascii(d) - 48).otherwise((F.ascii(d) - 48) * 2 - F.when(F.ascii(d) > 52, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def octets(m: Column) -> Column:
    """All four parts are at most 255."""
    bare = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.concat(F.lit("0"), F.substring(p, 1, 3)).cast("int") <= 255))


def checked(kind: str, m: Column) -> Column:
    d = _digits(m)
    if kind == "ip":
        return octets(m)
    if kind == "card":
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))
    return F.length(d).between(10, 15) if kind == "phone" else F.lit(True)


def _class(c: Column) -> Column:
    """0 edge or space, 1 letter, 2 digit, 3 other."""
    return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)


def _code(kind: str, c: Column) -> Column:
    m = c["m"]
    # past a separator, what stands next to the candidate
    before, after = F.regexp_extract(F.right(c["b"], F.lit(2)), r"(.)[\x20().-]?$", 1), F.regexp_extract(c["a"], r"^[\x20().-]?(.)", 1)
    if kind == "secret":
        kinds = sum((m.rlike(x).cast("int") for x in ("[a-z]", "[A-Z]", "[_/+=-]")), F.lit(0))
        values = {"hex": m.rlike("^[0-9a-fA-F]+$").cast("int"), "digits": F.floor(F.least(F.length(m), F.lit(64)) / 4) - 1, "groups": F.least(F.floor(F.length(_digits(m)) * 8 / F.length(m)), F.lit(7)), "cue": F.lit(0), "plus": F.lit(0), "marks": kinds}
    else:
        d, groups = F.length(_digits(m)), F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)))
        values = {
            "hex": F.lit(0), "digits": F.least(d, F.lit(19)) - F.least(d, F.lit(4)), "groups": F.least(groups, F.lit(7)), "cue": F.right(c["b"], F.lit(24)).rlike(CUES).cast("int"), "plus": m.startswith("+").cast("int"),
            "marks": F.when(m.contains("."), 3).when(m.contains("("), 2).when(m.rlike("[ -]"), 1).otherwise(0),
        }
    # quotes go with the names that label secrets, so a secret's model sees its format alone
    values |= {"before": F.lit(0), "after": F.lit(0)} if kind == "secret" else {"before": _class(before), "after": _class(after)}
    code, at = F.lit(0), 0
    for name, bits in FEATURES.items():
        code = code + F.least(values[name], F.lit((1 << bits) - 1)) * (1 << at)
        at += bits
    return code.cast("int")


def _windows(run: Column) -> Column:
    """Of a run {s, e, m}: every sequence of neighbouring digit groups with its place in the text."""

    def cut(groups: Column, i: Column, j: Column) -> Column:
        first, last, more = F.get(groups, i), F.get(groups, j), F.slice(groups, i + 2, j - i)
        # a plus sign or bracket that opens the run belongs to its first group; inside a run the neighbours are digits
        lead = F.when(i == 0, first["b"]).otherwise("")
        text = F.concat(lead, first["m"], F.array_join(F.transform(more, lambda g: F.concat(g["b"], g["m"])), ""))
        s = F.when(i == 0, F.lit(0)).otherwise(first["s"])
        return F.struct((run["s"] + s).alias("s"), (run["s"] + last["e"]).alias("e"), text.alias("m"), F.when(i == 0, run["b"]).otherwise("0").alias("b"), F.when(j == F.size(groups) - 1, run["a"]).otherwise("0").alias("a"))

    def all_of(groups: Column) -> Column:
        last = F.size(groups) - 1
        return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, F.least(last, i + LONGEST - 1)), lambda j: cut(groups, i, j))))

    # the array of one binds the groups, so they are found once
    return F.flatten(F.transform(F.array(spans_of(run["m"], "[0-9]+", "[0-9]")), all_of))


#: Shapes of candidates by kind.
SHAPE = {"ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", "card": r"^[0-9](?:[ -]?[0-9]){13,18}$", "phone": r"^\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){9,14}$"}


def _only(f, *fixed):
    """A one-argument lambda for a higher-order function."""
    return lambda c: f(*fixed, c)


def _good(kind: str, c: Column) -> Column:
    return checked(kind, c["m"])


def _shaped(kind: str, c: Column) -> Column:
    return c["m"].rlike(SHAPE[kind]) & checked(kind, c["m"])


def _tag(i: int, c: Column) -> Column:
    return F.struct(c["s"].alias("s"), F.lit(i).alias("kind"), c["e"].alias("e"))


def _candidate(i: int, kind: str, c: Column) -> Column:
    named = c["b"].rlike(ASSIGNED) if kind == "secret" else F.lit(None).cast("boolean")
    return F.struct(F.lit(i).alias("kind"), c["s"].alias("s"), c["e"].alias("e"), _code(kind, c).alias("code"), named.alias("named"))


def examined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__row, id, base spans and candidates of every document: sorted arrays of {s, kind, e}, and {kind, s, e, code, named}."""
    out = docs.select("__row", F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    out = out.withColumns({f"raw_{k}": spans_of(F.col("t"), BASE[k], NEEDS[k]) for k in KINDS})
    tagged = [F.transform(F.filter(f"raw_{k}", _only(_good, k)), _only(_tag, i)) for i, k in enumerate(KINDS)]
    out = out.withColumn("base", F.array_sort(F.concat(*tagged))).withColumn("runs", F.filter(spans_of(F.col("t"), RUN, "[0-9]"), lambda c: F.length(c["m"]) >= 7))
    out = out.withColumn("windows", F.flatten(F.transform("runs", _windows)))
    shaped = {
        "email": F.concat(spans_of(F.col("t"), SPELT, r"(?i)[\[(]at[\])]"), F.col("raw_email")), "secret": spans_of(F.col("t"), SECRET, "[0-9A-Za-z_/+=-]{16}"),
        **{k: F.filter("windows", _only(_shaped, k)) for k in SHAPE},
    }
    made = [F.transform(shaped[k], _only(_candidate, i, k)) for i, k in enumerate(ALL_KINDS)]
    return out.withColumn("cands", F.concat(*made)).select("__row", "id", "base", "cands")


def _stretches(spans: DataFrame) -> DataFrame:
    """A row per stretch of text that a span (s, e) touches."""
    at = lambda c: F.floor(c / STRETCH).cast("int")
    return spans.withColumn("_at", F.explode(F.sequence(at(F.col("s")), at(F.greatest(F.col("s"), F.col("e") - 1)))))


def candidates(seen: DataFrame) -> DataFrame:
    """__row, test, kind, s, e, code, known (true, false, or null if nothing tells) and free (overlaps no base span)."""
    own = seen.where(F.size("cands") > 0)
    cands = own.select("__row", (fold("id", 2) == 0).alias("test"), F.inline("cands")).distinct()
    base = own.select("__row", F.inline("base")).select("__row", "s", "e", F.col("kind").alias("b_kind"), F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    met = _stretches(cands.select("__row", "kind", "s", "e")).join(_stretches(base).drop("s", "e"), ["__row", "_at"]).where("s < b_e and e > b_s")
    same = F.bool_or(F.expr("kind = b_kind and s = b_s and e = b_e"))
    told = met.groupBy("__row", "kind", "s", "e").agg(same.alias("is_base"))
    both = cands.join(told, ["__row", "kind", "s", "e"], "left")
    known = F.when(F.col("kind") == ALL_KINDS.index("secret"), F.col("named")).otherwise(F.col("is_base"))
    return both.select("__row", "test", "kind", "s", "e", "code", known.alias("known"), F.col("is_base").isNull().alias("free"))


def _value(code: int, feature: str) -> int:
    at = 0
    for name, bits in FEATURES.items():
        if name == feature:
            return code >> at & ((1 << bits) - 1)
        at += bits
    raise KeyError(feature)


def boost(table: list[tuple[int, int, int]]) -> tuple[float, list[tuple]]:
    """(offset, trees) from rows (code, negatives, positives): depth-two trees on the logistic loss.

    A tree is (feature, at most, (feature, at most, low, high) for its low side, the same for its high side).
    """
    pos, neg = sum(p for *_, p in table), sum(n for _, n, _ in table)
    offset = math.log((pos + 0.5) / (neg + 0.5))
    score = dict.fromkeys((c for c, *_ in table), offset)
    names, trees = list(FEATURES), []
    seen = {c: tuple(_value(c, f) for f in names) for c in score}

    def leaf(rows: list[tuple[int, float, float]]) -> tuple[float, float]:
        g, h = sum(r[1] for r in rows), sum(r[2] for r in rows) + 1.0
        return SHRINK * g / h, g * g / h

    def split(rows: list[tuple[int, float, float]]) -> tuple[float, int, int, list, list]:
        best = (-1.0, 0, -1, [], rows)
        for f in range(len(names)):
            for cut in sorted({seen[r[0]][f] for r in rows})[:-1]:
                low, high = [r for r in rows if seen[r[0]][f] <= cut], [r for r in rows if seen[r[0]][f] > cut]
                gain = leaf(low)[1] + leaf(high)[1]
                if gain > best[0] + 1e-12:
                    best = (gain, f, cut, low, high)
        return best

    for _ in range(ROUNDS):
        rows = []
        for c, n, p in table:
            q = 1 / (1 + math.exp(-score[c]))
            rows.append((c, p * (1 - q) - n * q, (n + p) * q * (1 - q)))
        _, f, cut, low, high = split(rows)
        sides = []
        for part in (low, high):
            _, f2, cut2, a, b = split(part)
            sides.append((f2, cut2, leaf(a)[0] if a else 0.0, leaf(b)[0] if b else 0.0))
        trees.append((f, cut, *sides))
        for c in score:
            f2, cut2, a, b = sides[seen[c][f] > cut]
            score[c] += b if seen[c][f2] > cut2 else a
    return offset, trees


def tree_score(code: int, model: tuple[float, list[tuple]]) -> float:
    names = list(FEATURES)
    total = model[0]
    for f, cut, low, high in model[1]:
        f2, cut2, a, b = high if _value(code, names[f]) > cut else low
        total += b if _value(code, names[f2]) > cut2 else a
    return total


def score_column(code: Column, model: tuple[float, list[tuple]]) -> Column:
    names = list(FEATURES)
    shift = {f: sum(list(FEATURES.values())[:i]) for i, f in enumerate(names)}
    part = lambda f: F.shiftright(code, shift[names[f]]).bitwiseAND((1 << FEATURES[names[f]]) - 1)
    total = F.lit(model[0])
    for f, cut, low, high in model[1]:
        side = lambda s: F.when(part(s[0]) > s[1], F.lit(s[3])).otherwise(F.lit(s[2]))
        total = total + F.when(part(f) > cut, side(high)).otherwise(side(low))
    return total


def learn(cands: DataFrame) -> dict[int, tuple]:
    """By kind: (model, threshold) from :func:`candidates`.  A kind without both labels has no model and adds nothing."""
    told = cands.where("known is not null")
    table = told.groupBy("test", "kind", "code").agg(F.count_if(~F.col("known")).alias("neg"), F.count_if("known").alias("pos")).collect()
    models = {}
    for kind in range(len(ALL_KINDS)):
        fit = sorted((r.code, r.neg, r.pos) for r in table if r.kind == kind and not r.test)
        held = sorted((r.code, r.neg, r.pos) for r in table if r.kind == kind and r.test)
        if not any(n for _, n, _ in fit) or not any(p for *_, p in fit):
            continue
        model = boost(fit)
        ranked = sorted(((tree_score(c, model), n, p) for c, n, p in held), reverse=True)
        threshold, neg, pos = math.inf, 0, 0
        for i, (s, n, p) in enumerate(ranked):
            neg, pos = neg + n, pos + p
            below = ranked[i + 1][0] if i + 1 < len(ranked) else s - 2.0
            if below < s and pos + 1 >= PRECISION * (pos + neg + 2):
                threshold = (s + below) / 2  # half-way to the next score that was seen
        models[kind] = (model, threshold)
    return models


def added(cands: DataFrame, models: dict[int, tuple]) -> DataFrame:
    """(__row, s, kind, e) of the candidates that are added."""
    score = F.lit(None).cast("double")
    for kind, (model, threshold) in models.items():
        if math.isfinite(threshold):
            full = score_column(F.col("code"), model)
            score = F.when((F.col("kind") == kind) & (full >= threshold), full).otherwise(score)
    fine = cands.where("free").withColumn("score", score).where("score is not null").select("__row", "s", "kind", "e", F.struct((-F.col("score")).alias("a"), "s", (-F.col("e")).alias("b"), "kind").alias("rank"))
    wide = _stretches(fine)
    other = wide.select("__row", "_at", F.col("s").alias("o_s"), F.col("e").alias("o_e"), F.col("rank").alias("o_rank"))
    beaten = wide.join(other, ["__row", "_at"]).where("s < o_e and e > o_s and o_rank < rank").select("__row", "s", "kind", "e").distinct()
    return fine.join(beaten, ["__row", "s", "kind", "e"], "left_anti").select("__row", "s", "kind", "e")


def find(docs: DataFrame, models: dict[int, tuple] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__row, id, base and added spans ({s, kind, e}, in that order), one row per document.

    Without ``models`` they are learnt from ``docs``.  Defined cases: a null or empty text has no spans; null and
    repeated ids are documents of their own; places are code points, ends exclusive; equal scores go to the earlier,
    then longer candidate; an empty table gives no rows; other columns are only read where ids repeat.
    """
    return _found(keyed(docs, id_col), models, id_col, text_col)


def _found(rows: DataFrame, models: dict[int, tuple] | None, id_col: str, text_col: str) -> DataFrame:
    seen = stored(examined(rows, id_col, text_col), "pii-seen")
    cands = stored(candidates(seen), "pii-candidates")
    models = learn(cands) if models is None else models
    more = added(cands, models).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("s", "kind", "e"))).alias("added"))  # at most a document's
    none = F.array().cast("array<struct<s:int,kind:int,e:int>>")
    return seen.join(more, "__row", "left").select("__row", F.col("id").alias(id_col), "base", F.coalesce("added", none).alias("added"))


def span_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def of_kind(kind: int):
    """Predicate on spans, for counting a kind."""
    return lambda c: c["kind"] == kind


def redact(docs: DataFrame, models: dict[int, tuple] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``redacted``, the text in which every span is its kind in angle brackets; of overlapping spans the last."""
    rows = keyed(docs, id_col)
    found = _found(rows, models, id_col, text_col).select("__row", F.reverse(F.array_sort(F.concat("base", "added"))).alias("__spans"))
    names = F.array(*map(F.lit, ALL_KINDS))
    start = F.struct(F.col(text_col).alias("t"), F.lit((1 << 31) - 1).alias("upto"))
    done = F.aggregate(
        "__spans", start,
        lambda a, c: F.when(c["e"] <= a["upto"], F.struct(F.concat(F.substring(a["t"], F.lit(1), c["s"]), F.lit("<"), F.get(names, c["kind"]), F.lit(">"), F.substring(a["t"], c["e"] + 1, F.length(a["t"]))).alias("t"), c["s"].alias("upto"))).otherwise(a),
        lambda a: a["t"],
    )
    return rows.join(found, "__row").select(*docs.columns, done.alias("redacted"))
