"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Four patterns give the base spans, which are the seeds. Every token with a digit or an @ (or run of digit groups)
is an instance; the words around it, on either side and at several widths, are its lexical patterns. Patterns and
distinct instances form a graph whose scores are computed in turn, in Spark: a pattern's score for a kind is the
share of its instances believed to be of it, among all it stands beside; those that could be of the kind by their
form and aren't believed to be weigh little. Patterns seen with enough different seeds and a high score lend it to
such instances, which count in the next round. What the last round's patterns stand beside, and no base span
touches, is marked. Base spans always stay.

The expressions are written so that time stays in proportion to the text: a run of name characters or of
digits is tried once, from its start or from where the last match ended, and never backtracked.

Nulls: null text is the empty text; a null doc_id stays. Repeats and ties: rows of equal doc_id and text get equal
spans, each on its own row, and copies of a text add no instance. Very long texts and tokens count whole; a pattern
is made of whole words. Empty tables give no rows. Extra columns of any name pass through redact and do not travel
otherwise. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusframe.checkpoints import discard, materialize, scratch
from argusframe.llm.common import unused
from argusframe.sizing import join_checked

# The kinds in their order and the expression of each, as its contract has it. The forms below
# them match the same spans: possessive, and starting only where a run starts or a match has just ended.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be worth looking for.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A pattern counts from so many different seeds on, and marks candidates from such a score on.
MIN_SEEDS = 8
MIN_SCORE = 0.8
ROUNDS = 3
#: What an instance that could be of a kind, but is not believed to be, weighs against a pattern.
DOUBT = 0.25
#: Forms of unseen identifiers, by kind: what an instance must match as a whole to be one.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]++(?:@|\(at\)|\[at\]|\{at\})[A-Za-z0-9-]++(?:(?:\.|\(dot\)|\[dot\])[A-Za-z0-9-]++)*+",
    "ip": r"(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}|(?:[0-9]{1,3}[-_]){3}[0-9]{1,3}",
    "card": r"[0-9](?:[\x20.-]?[0-9]){12,18}",
    "phone": r"\(?[0-9]{1,5}\)?(?:[\x20./-]{0,2}\(?[0-9]{1,5}\)?){1,5}",
}
PHONE_DIGITS = (7, 15)
#: An instance as it stands in a text: digit groups with single spaces between, or any token with a digit or an @.
GROUP = r"[(+]?[0-9][0-9()./-]*+(?![^\x20\x09-\x0D])"
SIGN = r"(?:[0-9@]|[(\[{]at[)\]}])"
INSTANCE = rf"(?<![^\x20\x09-\x0D])(?:{GROUP}(?:\x20{GROUP})++|(?=[^\x20\x09-\x0D]*?{SIGN})[^\x20\x09-\x0D]++)"
#: Of a token: what names the value and is written together with it, and marks around it.
LABEL = r"^[\p{L}_-]+[:=]+"
OPENING = r"^(?:[\"'<\[{,;:=]|\((?=[^)]*$))+"
CLOSING = r"[\"'>\]},;:.!?]+$"
CLOSING_OPEN = r"[\"'>\]}),;:.!?]+$"
BLANKS_FROM = "\t\n\x0b\f\r"


def matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """All matches of a pattern, and the stretches between them: split and extract find the same matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def nearby(between: Column, i: Column) -> tuple[Column, Column]:
    """The stretches before and after match i, blanks as spaces and none at the match."""
    plain = lambda at: F.translate(F.coalesce(F.get(between, at), F.lit("")), BLANKS_FROM, " " * len(BLANKS_FROM))
    return F.rtrim(plain(i)), F.ltrim(plain(i + 1))


def located(found: Column, between: Column, with_words: bool = False) -> Column:
    """Matches as structs of text, start and end, and with up to two words before and one after if wanted. Starts
    are running sums over blocks of about the square root of their number, so a text of very many matches costs
    little more than its length."""
    steps = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(between, i)))
    width = F.ceil(F.sqrt(F.size(found))).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    block = lambda xs, b, n: F.slice(xs, b * width + 1, n)
    sums = F.transform(F.sequence(F.lit(0), width - 1), lambda b: total(block(steps, b, width)))
    whole = F.struct(found.alias("m"), between.alias("g"), steps.alias("s"), width.alias("w"), sums.alias("b"))

    def place(z: Column) -> Column:
        bases = F.transform(z["b"], lambda _, i: total(F.slice(z["b"], F.lit(1), i)))
        with_bases = F.array(F.struct(z["m"].alias("m"), z["g"].alias("g"), z["s"].alias("s"), z["w"].alias("w"), bases.alias("c")))

        def starts(y: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                b = F.floor(i / y["w"]).cast("int")
                at = F.get(y["c"], b) + total(F.slice(y["s"], b * y["w"] + 1, i - b * y["w"])) + F.length(F.get(y["g"], i))
                columns = [m.alias("t"), at.alias("s"), (at + F.length(m)).alias("e")]
                if with_words:
                    before, after = nearby(y["g"], i)
                    columns += [F.substring_index(before, " ", -2).alias("l"), F.substring_index(after, " ", 1).alias("r")]
                return F.struct(*columns)

            return F.transform(y["m"], one)

        return F.get(F.transform(with_bases, starts), F.lit(0))

    nothing = F.array().cast(f"array<struct<t:string,s:int,e:int{',l:string,r:string' if with_words else ''}>>")
    return F.when(F.size(found) > 0, F.get(F.transform(F.array(whole), place), F.lit(0))).otherwise(nothing)


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(t: Column) -> Column:
    """Whether the digits of a text pass the check-digit sum: every second from the right doubled."""
    d = F.split(F.reverse(digits(t)), "")
    value = lambda x, i: F.when(i % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)
    values = F.transform(F.filter(d, lambda x: x != ""), lambda x, i: value(x.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def fits(kind: str, t: Column) -> Column:
    n = F.length(digits(t))
    if kind == "ip":
        return t.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), luhn(t)).otherwise(False)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def with_base_spans(docs: DataFrame, *kept: Column) -> DataFrame:
    """doc_id, _key (of the text), one array of located base spans a kind, and the columns ``kept``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t"), *kept)
    more = rows.columns[2:]
    rows = rows.withColumn("_digit", F.col("_t").rlike("[0-9]"))
    t = F.col("_t")
    none = F.array().cast("array<string>")
    for kind in KINDS:
        worth = F.col("_digit") if kind != "email" else F.lit(True)
        if NEEDS[kind]:
            worth = worth & t.contains(NEEDS[kind])
        found, between = matches(t, LINEAR[kind])
        rows = rows.withColumn(f"_m_{kind}", F.when(worth, found).otherwise(none))
        rows = rows.withColumn(f"_g_{kind}", F.when(F.size(f"_m_{kind}") > 0, between).otherwise(none))
    fitting = lambda kind: lambda x: fits(kind, x["t"])
    spans = [F.filter(located(F.col(f"_m_{k}"), F.col(f"_g_{k}")), fitting(k)).alias(k) for k in KINDS]
    return rows.select("doc_id", F.xxhash64("_t").alias("_key"), *spans, *more)


def instances(docs: DataFrame) -> DataFrame:
    """Every instance where it stands: doc_id, _key, start, end, token, patterns, seed (its kind if a base span is in
    it) and kinds (what it might be by its form)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t")).where(F.col("_t").rlike(SIGN))
    found, between = matches(F.col("_t"), INSTANCE)
    rows = rows.select("doc_id", F.xxhash64("_t").alias("_key"), found.alias("_m"), between.alias("_g")).where(F.size("_m") > 0)
    rows = rows.select("doc_id", "_key", F.explode(located(F.col("_m"), F.col("_g"), True)).alias("x")).select("doc_id", "_key", "x.*")
    label = F.regexp_extract("t", LABEL, 0)
    rows = rows.withColumn("_label", label).withColumn("_rest", F.expr("substring(t, length(_label) + 1)"))
    rows = rows.withColumn("_bare", F.regexp_replace("_rest", OPENING, ""))
    rows = rows.withColumn(
        "token", F.when(F.col("_bare").contains("("), F.regexp_replace("_bare", CLOSING, "")).otherwise(F.regexp_replace("_bare", CLOSING_OPEN, ""))
    )
    start = F.col("e") - F.length("_bare")
    fitting = lambda kind: lambda x: fits(kind, x)
    seed = F.coalesce(*[F.when(F.exists(matches(F.col("t"), LINEAR[k])[0], fitting(k)), k) for k in KINDS])
    n = F.length(digits(F.col("token")))
    enough = {"phone": (n >= PHONE_DIGITS[0]) & (n <= PHONE_DIGITS[1])}
    kinds = F.array_compact(F.array(*[F.when(F.col("token").rlike(f"^(?:{FORMS[k]})$") & enough.get(k, F.lit(True)), k) for k in KINDS]))
    norm = lambda c: F.lower(F.regexp_replace(c, "[0-9]+", "9"))
    one = norm(F.when(F.col("_label") != "", F.col("_label")).otherwise(F.substring_index("l", " ", -1)))
    two = norm(F.when(F.col("_label") != "", F.concat_ws(" ", F.substring_index("l", " ", -1), "_label")).otherwise(F.col("l")))
    after = norm(F.col("r"))
    patterns = F.array_distinct(
        F.array(F.concat(F.lit("1<"), one), F.concat(F.lit("2<"), two), F.concat(F.lit(">"), after), F.concat(F.lit("<>"), one, F.lit(" _ "), after))
    )
    named = F.filter(patterns, lambda p: ~p.isin("1<", "2<", ">", "<> _ "))
    out = rows.select(
        "doc_id", "_key", start.alias("start"), (start + F.length("token")).alias("end"), "token", named.alias("patterns"), seed.alias("seed"),
        kinds.alias("kinds")
    )
    return out.where("token <> ''")


def discover(docs: DataFrame) -> DataFrame:
    """doc_id, _key and extra: located spans with their kind that high-confidence patterns mark. Materialised."""
    with scratch() as held:
        seen = materialize(instances(docs), "pii-instances")
        edges = seen.select("token", "seed", "kinds", F.explode("patterns").alias("pattern"))
        edges = materialize(edges.groupBy("pattern", "token").agg(F.max("seed").alias("seed"), F.first("kinds").alias("kinds")), "pii-graph")
        # Only patterns that stand beside enough different seeds of a kind can ever be trusted.
        worth = edges.where("seed IS NOT NULL").groupBy("pattern", "seed").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SEEDS)
        worth = materialize(worth.select("pattern").distinct(), "pii-worth")
        edges = materialize(join_checked(edges, worth, "pattern", "left_semi"), "pii-edges")
        total = materialize(edges.groupBy("pattern").agg(F.count("*").alias("n")), "pii-totals")
        kinds = F.when(F.col("seed").isNotNull(), F.array("seed")).otherwise(F.col("kinds"))
        graph = materialize(edges.select("pattern", "token", F.explode(kinds).alias("kind"), F.col("seed").isNotNull().alias("is_seed")), "pii-kinds")
        belief = materialize(
            graph.groupBy("token", "kind").agg(F.max(F.col("is_seed").cast("double")).alias("belief"), F.max("is_seed").alias("is_seed")), "pii-beliefs"
        )
        trusted = None
        for _ in range(ROUNDS):
            sums = graph.drop("is_seed").join(belief, ["token", "kind"]).groupBy("pattern", "kind")
            by_kind = sums.agg(
                F.sum("belief").alias("believed"), F.sum(F.greatest("belief", F.lit(DOUBT))).alias("weight"), F.count("*").alias("forms"),
                F.count_if("is_seed").alias("seeds")
            )
            score = F.col("believed") / (F.col("n") - F.col("forms") + F.col("weight"))
            scores = by_kind.where(F.col("seeds") >= MIN_SEEDS).join(total, "pattern").select("pattern", "kind", score.alias("score"))
            trusted = materialize(scores.where(F.col("score") >= MIN_SCORE), "pii-patterns")
            grown = join_checked(
                graph.select("pattern", "token", "kind"), trusted, ["pattern", "kind"]
            ).groupBy("token", "kind").agg(F.max("score").alias("grown"))
            updated = belief.join(grown, ["token", "kind"], "left").select(
                "token", "kind", F.when(F.col("is_seed"), 1.0).otherwise(F.coalesce("grown", F.lit(0.0))).alias("belief"), "is_seed"
            )
            was, belief = belief, materialize(updated, "pii-beliefs")
            discard(was)
        trusted = materialize(trusted.drop("score"), "pii-patterns")
        near = seen.where("seed IS NULL AND size(kinds) > 0").select("doc_id", "_key", "start", "end", F.explode("kinds").alias("kind"), "patterns")
        near = near.select("doc_id", "_key", "start", "end", "kind", F.explode("patterns").alias("pattern"))
        marked = join_checked(near, trusted, ["pattern", "kind"], "left_semi")
        extra = marked.groupBy("doc_id", "_key").agg(F.collect_set(F.struct("kind", F.col("start").alias("s"), F.col("end").alias("e"))).alias("extra"))  # spans of one text
        extra = materialize(extra.select(F.col("doc_id").alias("_x_id"), F.col("_key").alias("_x_key"), "extra"), "pii-extra")
        held.pass_on(extra)
    return extra


def find(docs: DataFrame, *kept: Column) -> DataFrame:
    """Per row: doc_id, base and spans: arrays of (o, s, e, kind) by kind as listed, then start; and ``kept``."""
    extra = discover(docs)
    span = lambda n, kind: lambda x: F.struct(F.lit(n).alias("o"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"))
    listed = [F.transform(k, span(n, k)) for n, k in enumerate(KINDS)]
    based = with_base_spans(docs, *kept)
    more = based.columns[2 + len(KINDS) :]
    rows = based.select("doc_id", "_key", F.concat(*listed).alias("base"), *more)
    same = F.col("doc_id").eqNullSafe(F.col("_x_id")) & (F.col("_key") == F.col("_x_key"))
    rows = join_checked(rows, extra, same, "left")
    number = F.create_map(*[F.lit(v) for n, k in enumerate(KINDS) for v in (k, n)])
    apart = lambda x: ~F.exists("base", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    added = F.transform(
        F.filter("extra", apart), lambda x: F.struct(number[x["kind"]].alias("o"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))
    )
    every = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", added)))
    return rows.select("doc_id", "base", every.alias("spans"), *more)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered. Counts are of base spans."""
    found = find(docs)
    of = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_discovered")
    )


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each found span of text replaced by its kind in brackets; where spans overlap,
    the one that starts first (then the longer) names the stretch. Base spans are found and replaced in one
    projection; only what patterns mark is joined to the texts."""
    (row,) = unused(docs, "_row")
    found = find(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    text = F.col(row)["text"].cast("string")
    order = lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))
    spans = F.array_sort(F.transform("spans", order))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["e"]
        fresh = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))
        return F.when(x["s"] >= acc["at"], F.struct(end.alias("at"), fresh.alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], end).alias("at"), acc["out"].alias("out"))
        )

    def close(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    clean = F.when(F.size("spans") == 0, text).otherwise(F.aggregate(spans, start, step, close))
    return found.select(*[clean.alias(c) if c == "text" else F.col(row)[c].alias(c) for c in docs.columns])
