"""Operators that compare documents, beside brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import SF, connect, differences
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize
from argusframe.llm import chat, line_dedup, near_dedup, passages, pii, queries, shingles, topk
from argusframe.llm.common import BLANKS


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


# --- lines


def brute_lines(rows):
    key = lambda line: lower(line.strip(BLANKS))
    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 40:
                    holders[key(line)].add(i)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or keeper.get(key(x), i) == i]
        out.append(str((i, len(lines), len(lines) - len(kept), sha("\n".join(kept)))))
    return sorted(out)


def lines_of(docs):
    got = line_dedup.dedup_lines(docs).select("doc_id", "_lines.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("s")).collect()
    return sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.s)) for r in got)


def test_lines_rules(spark, odd, none):
    shared = "This LINE is shared by many documents of the table"
    rows = [(i, f"head {i}\n  {shared.upper() if i % 2 else shared}\t\ntail\n{shared}") for i in range(7)] + [(20, shared), (20, shared), (None, shared)] + [(30 + i, "four documents only hold this one line of text") for i in range(4)]
    rows += [(40 + i, "exactly forty code points are in this é!\n" + "x" * 39) for i in range(5)] + [(50, None), (51, ""), (52, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines_of(docs) == brute_lines(rows)
    assert lines_of(odd) == brute_lines([(r.doc_id, r.text) for r in odd.collect()])
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.dedup_lines(odd).columns == [*odd.columns, "_lines"]


def test_lines_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256)) for r in queries.op6_line_dedup(spark, SF).collect())
    assert got == brute_lines(rows)


# --- near duplicates


def word_set(text, k=5):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_groups(rows):
    sets = {i: word_set(t) for i, t in rows}
    name, held = {i: i for i in sets}, defaultdict(list)

    def top(x):
        while name[x] != x:
            x = name[x]
        return x

    for i, s in sets.items():
        seen = Counter(j for h in s for j in held[h])
        for j, n in seen.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                name[b] = a
        for h in s:
            held[h].append(i)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def family(rng, base, n, start, words):
    """Copies of a text with one to many words changed."""
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, len(w) // 25)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((start + i, " ".join(w)))
    return out


def test_near_groups(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(100)]
    rows += family(rng, [rng.choice(words) for _ in range(120)], 120, 1000, words) + family(rng, [rng.choice(words) for _ in range(60)], 60, 2000, words)
    rows += [(3000 + i, "one two three four five six seven eight") for i in range(30)] + [(3100, "ONE two three four five six seven eight nine"), (3101, "one two"), (3102, "ONE\ttwo\n"), (3103, "three"), (3104, None), (3105, " \n"), (3106, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.group(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = {r.doc_id for r in near_dedup.keep_one(docs).collect()}
    assert kept == {r.doc_id for r in got if r.kept}


def test_near_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_near_dedup(spark, SF).collect()} == brute_groups(rows)


def test_near_odd_rows(spark, odd, none):
    got = near_dedup.group(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].component_id == 4 and not by[5].kept and by[7].component_id == 7 and by[1].n_shingles == 0
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_dedup.group(none).count() == 0 and near_dedup.keep_one(odd).columns == odd.columns


def test_near_texts_that_share_a_doc_id(spark):
    """Each text counts: what is dropped has a near copy that stays, and one row of each component stays."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    a, b, c = ([word() for _ in range(60)] for _ in range(3))
    near = lambda w: " ".join([*w[:58], word(), word()])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (0, near(a)), (3, near(b)), (5, " ".join(b)), (7, " ".join(c)), (7, " ".join(c)), (7, near(c)), (8, " ".join(c)), (9, None), (9, ""), (9, "alone here"), (None, " ".join(a)), (2, "x"), (2, "y")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, component long")
    sets = [word_set(t) if i is not None else frozenset() for i, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                root[top(x)] = top(y)
    least = {x: min((rows[y][0] for y in range(len(rows)) if top(y) == top(x) and rows[y][0] is not None), default=None) for x in range(len(rows))}
    want = Counter((i, len(word_set(t)), least[x] if sets[x] else i) for x, (i, t) in enumerate(rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.group(docs).collect()) == want
    kept = {r.component for r in near_dedup.keep_one(docs).collect()}
    for x in range(len(rows)):
        same = [y for y in range(len(rows)) if top(y) == top(x)]
        assert len(kept.intersection(same)) == 1, (x, same, kept)
        assert not sets[x] or {rows[y][0] for y in kept.intersection(same)} == {least[x]}


def test_near_family_of_strangers_and_copies(spark):
    """Links that hubs leave out are found, and no more of them than join the parts."""
    asked = [(i, np.arange(100 + i, dtype=np.uint64)) for i in range(20)]
    joined = near_dedup.Parts()
    found = list(near_dedup.match_block(asked, asked, 75, joined))
    assert len(found) == 19 and len({joined.root(i) for i in range(20)}) == 1


def test_densified_signatures_estimate():
    rng = np.random.default_rng(0)
    for n in (4, 30, 2000):
        hits = []
        for _ in range(60):
            both = rng.integers(0, 2**63, n, dtype=np.uint64)
            a, b = np.unique(np.append(both, rng.integers(0, 2**63, 1, dtype=np.uint64))) * np.uint64(2), np.unique(both) * np.uint64(2)
            hits.append((shingles.one_permutation(a) == shingles.one_permutation(b)).mean())
        assert abs(np.mean(hits) - n / (n + 1)) < 0.05


# --- passages


def test_passages(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, near = some(55), some(60).split()
    other = list(near)
    other[30] = "changed"
    rows = [(1, f"{some(30)}\n{shared}\n{some(20)}"), (2, f"{some(400)} {shared} {some(300)}"), (3, some(80)), (4, f"{some(9)}\n{' '.join(near[:50])}"), (5, f"{' '.join(other[:50])}\n{some(8)}"), (6, f"{shared}"), (7, None), (8, ""), (9, f"x\n{some(500)}"), (9, some(50))]
    rows += [(10, s := some(100)), (10, s), (None, shared)]
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2, 4, 5, 6}
    first = {r.doc_id: r.kept for r in got}
    assert first[1] and not first[2] and not first[6] and first[4] and not first[5]
    near_rows = {r.doc_id: r.cluster_id for r in got if r.doc_id in (4, 5)}
    assert near_rows[4] == near_rows[5]


def test_passages_recall(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i, t.lower().split()) for i, t in docs]
    holders = lambda n: {i for ids in _held(rows, n).values() if len(ids) > 1 for i in ids}
    got = {r.doc_id for r in queries.op2_passages(spark, SF).collect()}
    assert holders(49) <= got
    lines = [(i, s) for i, t in docs for line in t.split("\n") if len(s := word_set(line)) >= 20]
    for i in got - holders(33):  # then it has nearly the same line as another
        assert any(100 * len(a & b) >= 75 * len(a | b) for x, a in lines if x == i for y, b in lines if y != i), i


def _held(rows, n):
    held = defaultdict(set)
    for i, w in rows:
        for k in range(len(w) - n + 1):
            held[tuple(w[k : k + n])].add(i)
    return held


def test_passages_odd_rows(spark, odd, none):
    assert passages.repeated(none).count() == 0
    assert {r.doc_id for r in passages.repeated(odd).collect()} == {4, 5}


def line_components(docs):
    """{class: component} by the operator, and the pairs of classes that brute force finds similar."""
    classes = passages.line_classes(materialize(passages.units(docs), "units"))
    classes = materialize(classes, "classes")
    of_node = {r.node: (r.c1, r.c2) for r in classes.collect()}
    parts = {of_node[r.node]: r.component for r in passages.clusters(docs, classes).collect()}
    memo, sets = shingles.WordHashes(), {}
    for r in docs.collect():
        p = passages.Paragraphs(r.text, memo)
        for name, a, w in zip(zip(p.names(p.first, p.words).tolist(), p.names(p.first, p.words, 1).tolist(), strict=True), p.first.tolist(), p.words.tolist(), strict=True):
            sets[name] = frozenset(p.shingles[a : a + w - 4].tolist())
    return parts, similar_pairs(sets)


def similar_pairs(sets):
    """All pairs of at least 0.75, by the rarest shingles of each: similar sets share one of them."""
    often = Counter(x for s in sets.values() for x in s)
    held, pairs = defaultdict(list), []
    for name, s in sets.items():
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-3 * len(s) // 4) + 1]
        for other in {o for x in rare for o in held[x]}:
            both = len(s & sets[other])
            if 100 * both >= 75 * (len(s) + len(sets[other]) - both):
                pairs.append((name, other))
        for x in rare:
            held[x].append(name)
    return pairs


def test_passages_recall_of_similar_lines(spark):
    """All pairs of similar lines among 10,000 documents, by brute force; at least 99 of 100 in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    parts, pairs = line_components(docs)
    together = sum(parts.get(a, a) == parts.get(b, b) for a, b in pairs)
    assert len(pairs) > 300 and together >= 0.99 * len(pairs), f"{together} of {len(pairs)}"


def test_passages_template_family(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(50)], []
    for i in range(150):  # two lines at 0.84, and at most 0.65 to all others of the template
        one = base[:40] + [word() for _ in range(10)]
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join([word() for _ in range(4)] + one[4:]))]
    parts, pairs = line_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(pairs) == 150
    lost = [p for p in pairs if p[0] not in parts or parts[p[0]] != parts.get(p[1])]
    assert not lost, f"{len(lost)} of {len(pairs)} pairs are apart"
    assert len({parts[x] for p in pairs for x in p}) == 150


def test_passages_long_lines(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, missed = [], []
    for i in range(100):
        one = [word() for _ in range(rng.randint(60, 150))]
        other = list(one)
        for at in rng.sample(range(len(one)), 2):
            other[at] = word()
        rows += [(2 * i, f"{word()}\n{' '.join(one)}"), (2 * i + 1, f"{' '.join(other)}\n{word()}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts, pairs = line_components(docs)
    assert len(pairs) >= 50
    assert [p for p in pairs if p[0] not in parts or parts[p[0]] != parts.get(p[1])] == []
    got = {(r.doc_id, r.n_words): r.cluster_id for r in passages.repeated(docs).collect()}
    for i in range(100):
        a, b = (got.get((d, len(rows[d][1].split()) - 1), got.get((d, len(rows[d][1].split())))) for d in (2 * i, 2 * i + 1))
        if a is None or a != b:
            missed.append(i)
    assert len(missed) <= 100 - len(pairs), f"{len(missed)} of 100 pairs are not one cluster of whole lines"


def test_passages_across_line_breaks(spark):
    rng = random.Random(10)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    wrap = lambda words, width: "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))
    rows = []
    for i in range(60):
        shared = some(60)
        rows += [(6 * i, wrap(some(31) + shared + some(20), 12)), (6 * i + 1, wrap(some(17) + shared + some(20), 15)), (6 * i + 2, f"{wrap(some(25), 10)}\n{' '.join(shared)}\n{wrap(some(5), 10)}")]
        cut = some(51)
        for k in (3, 4):  # in two lines under 30 words, whole in neither
            rows.append((6 * i + k, f"{' '.join(some(3) + cut[:25])}\n{' '.join(cut[25:] + some(3))}"))
        rows.append((6 * i + 5, wrap(some(100), 12)))
    got = {r.doc_id for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i for i, _ in rows if i % 6 < 5}
    assert got == want, f"{len(want - got)} of {len(want)} documents are missing, {len(got - want)} are too many"


def test_passages_exact_in_long_lines(spark):
    rng = random.Random(11)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows = []
    for i in range(800):
        shared = some(51)
        rows += [(2 * i + k, " ".join(some(rng.randint(30, 60)) + shared + some(rng.randint(30, 60)))) for k in (0, 1)]
    got = {r.doc_id for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows), f"{len(rows) - len(got)} of {len(rows)} documents are missing"


# --- personal data

BASE = {k: re.compile(p) for k, p in pii.PATTERNS.items()}


def fits(kind, text):
    d = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in BASE[k].finditer(text or "") if fits(k, m[0])]


def same_spans(got, text):
    spans = base_spans(text)
    assert got.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)), (text or "")[:200]
    assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
    assert {f"{k}:{a}:{b}" for k, a, b in spans} <= {*got.spans.split(",")}


def test_pii_base(spark, none):
    rng = random.Random(3)
    bits = ["a@b.c", "_d@e.f", "x", " ", "1.2.3.4", "255.1.1.256", ".", "9", "4111 1111 1111 1111", "4111111111111111", "-", "+1 (555) 010-9999", "+44", "é", "\U0001f600", "@", "\n", "0", "4929 ", "00.01.002.0003", "a.b", "(", ")"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(700)]
    texts += [None, "", "a" * 20_000 + "1" * 20_000 + " 1" * 5_000 + "@" + "b." * 3_000, "call +1 555 0100 0000 " * 400, "1" * 40_000, "1." * 10_000, "+" * 5_000 + "1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for i, t in enumerate(texts):
        same_spans(got[i], t)
    assert pii.report(none).count() == 0


def test_pii_query_and_odd_rows(spark, odd):
    got = {r.doc_id: r for r in queries.op4_pii(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        same_spans(got[r.doc_id], r.text)
    assert pii.report(odd).count() == odd.count()


def test_pii_discovery_and_redaction(spark):
    rows = [(i, f"word Handy: +49 170 {1234567 + i} ende") for i in range(8)] + [(100, "mehr Handy: 0170-5551-234 und so"), (101, "the 0170-5551-234 ok"), (102, None), (103, "clean"), (104, "a@b.co c@d.ef")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("x")).withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert got[100].spans == "phone:12:25" and got[100].n_phone == 0 and got[101].spans == "" and got[100].n_discovered == 1
    clean = pii.redact(docs)
    text = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and text[100] == "mehr Handy: [PHONE] und so" and text[3] == "word Handy: [PHONE] ende" and text[101] == rows[9][1] and text[102] is None and text[104] == "[EMAIL] [EMAIL]"


PLANTED = {  # contexts, forms the base has, forms it misses
    "phone": (["Handy:", "call me at", "ruf an unter"], lambda r: f"+49 170 {r.randrange(10**6, 10**7)}", [lambda r: f"0170-{r.randrange(10**3, 10**4)}-{r.randrange(100, 1000)}", lambda r: f"(030) 555-{r.randrange(10**3, 10**4)}"]),
    "email": (["E-Mail an", "write to", "contact <"], lambda r: f"m{r.randrange(10**6)}@mail.example.com", [lambda r: f"m{r.randrange(10**6)}(at)mail.de", lambda r: f"m{r.randrange(10**6)}[at]post[dot]org"]),
    "ip": (["server IP", "login from host"], lambda r: ".".join(str(r.randrange(256)) for _ in range(4)), [lambda r: "-".join(str(r.randrange(10, 256)) for _ in range(4)), lambda r: ":".join(f"{r.randrange(1, 65536):x}" for _ in range(8))]),
}


def test_pii_discovers_planted_identifiers(spark):
    """Forms that no base expression has, beside contexts learned from those it has; the same forms stand in neutral
    contexts too, where they must be left alone."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(800)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, planted, seen = [], set(), set()
    for kind, (contexts, seed, forms) in PLANTED.items():
        for context in contexts:
            glue = "" if context.endswith("<") else " "
            for n in range(60):
                form = seed if n < 40 else forms[n % len(forms)]
                value, before = form(rng), f"{some(rng.randint(3, 30))} {context}{glue}"
                if n >= 40:
                    planted.add((len(rows), f"{kind}:{len(before)}:{len(before) + len(value)}"))
                rows.append((len(rows), f"{before}{value}{'>' if glue == '' else ''} {some(rng.randint(3, 30))}"))
        for _ in range(60):
            rows.append((len(rows), f"{some(20)} {rng.choice(['order', 'page', 'part no.'])} {rng.choice(forms)(rng)} {some(20)} {rng.randrange(5000)} {some(3)}"))
    got = pii.report(spark.createDataFrame(rows, "doc_id long, text string")).where("n_discovered > 0").collect()
    for r in got:
        seen |= {(r.doc_id, x) for x in r.spans.split(",")} - {(r.doc_id, f"{k}:{a}:{b}") for k, a, b in base_spans(rows[r.doc_id][1])}
    precision, recall = len(seen & planted) / max(len(seen), 1), len(seen & planted) / len(planted)
    assert precision >= 0.95 and recall >= 0.9, (precision, recall, sorted(planted - seen)[:5], sorted(seen - planted)[:5])


def test_pii_supplied_tables_hold_no_other_identifiers(spark):
    """Why nothing is discovered there: whatever has a digit or an @ and no base span is a number that fails its
    check digit, a version, a key of hexadecimal digits, or a part of one of these."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    known = re.compile(r"[\"'(]*(?:\d{16}|\d{1,2}(?:\.\d)?|[0-9a-f]{32,40})[\"')]*\W*", re.I)
    odd = Counter()
    for r in rows:
        covered = [(a, b) for _, a, b in base_spans(r.text)]
        for m in re.finditer(r"\S*[0-9@]\S*", r.text or ""):
            if not known.fullmatch(m[0]) and not any(a < m.end() and b > m.start() for a, b in covered):
                odd[m[0]] += 1
    assert sum(odd.values()) <= 20, odd.most_common(10)


def test_pii_needs_many_seeds(spark):
    """Copies of one document are one seed: they make no pattern."""
    rows = [(i, "word Handy: +49 170 1234567 ende") for i in range(50)] + [(100, "mehr Handy: 0170-5551-234 und so")]
    assert pii.report(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_discovered")).first()[0] == 0


def test_pii_plan_has_no_python(spark):
    plan = pii.with_base_spans(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- search


def brute_top(rows, is_query, k=5):
    ids = [i for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    vectors = [[int(np.floor(256 * np.float64(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in zip(ids, vectors, strict=True):
        if is_query(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in zip(ids, vectors, strict=True) if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def test_topk_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op3_exact_topk(spark, SF).collect())) == brute_top(rows, lambda i: i % 50 == 0)


def test_topk_ties_and_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-2, 2)) / 4 for _ in range(6)]) for i in range(0, 400)] + [(500 + i, [0.25] * 6) for i in range(40)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, [1.0]), (1005, []), (None, [1.0] * 6), (1006, [0.0] * 6)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(docs, F.col("vec_id") % 2 == 0).collect()))
    assert got == brute_top(rows, lambda i: i % 2 == 0)
    assert topk.top_k(docs.limit(0), F.col("vec_id") % 2 == 0).count() == 0
    assert topk.top_k(docs, F.lit(False)).count() == 0
    equal = spark.createDataFrame([(7, [1.0])] * 300 + [(7, [0.5]), (8, [1.0]), (9, [0.25])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(equal, F.col("vec_id") == 9).orderBy("rank").collect()] == [(7, 64 * 256)] * 5
    wide = spark.createDataFrame([(i, [float(2**12 + i)] * 3000) for i in range(3)], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(wide, F.col("vec_id") == 0).orderBy("rank").collect()] == [(i, 3000 * 2**20 * (2**20 + 256 * i)) for i in (2, 1)]
    big = spark.createDataFrame([(0, [1e12, 3.0]), (1, [1e12, 1.0]), (2, [1e12, 2.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.top_k(big.where("vec_id < 3"), F.col("vec_id") == 0).orderBy("rank").collect()] in ([2, 1], [1, 2])


@pytest.mark.parametrize("spread", [1, 20, 120])
def test_index_stops_only_on_proof(spread):
    rng = np.random.default_rng(spread)
    vectors = np.round(rng.normal(0, spread, (1500, 16)))
    index = topk.ImpactIndex(np.arange(1500), vectors)
    for q in range(0, 1500, 75):
        scores = vectors @ vectors[q]
        want = [i for i in np.lexsort((np.arange(1500), -scores)) if i != q][:5]
        assert index.search(q, vectors[q]) == [(int(i), scores[i]) for i in want]


# --- SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name]) == []


# --- chat


def read(rows, df):
    turns = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns[c].append((role or "", text or ""))
    got = {r.conv_id: r for r in df.collect()}
    assert got.keys() == turns.keys()
    for c, said in turns.items():
        r, loss = got[c], "".join(t for role, t in said if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(said), sha("".join(f"{a}\n{b}\n" for a, b in said)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)) and r.formatted_chars > r.loss_chars
    return got


def test_chat(spark):
    t = chat.Template()
    tricky = ["", None, "\\", "\\\\<s>", "<s>", "</s>[INST] ok [/INST]", "<<s>", "<<SYS>>\\", "<<<SYS>>", "\\<eot\\>", "\n\n", "\U0001f600<eot>", "<<ROLE>>x<</ROLE>>", "[INST" + "]" * 3, "x" * 100_000]
    rows = [(i, n, r, s) for i, s in enumerate(tricky) for n, r in enumerate(("system", "user", "assistant"))]
    rows += [(100, 0, "tool<eot>", "a"), (100, 1, None, "b"), (101, 0, "user", "a"), (101, 0, "assistant", "tie"), (None, 1, "user", "no id"), (102, None, "assistant", "first"), (102, 0, "user", "u"), (103, 0, "user", "q"), (103, 1, "user", "q"), (104, 0, "user", "same"), (104, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1)).withColumn("loss", F.lit("x"))
    segments = chat.format_conversations(df, t)
    got = read(rows, chat.read_back(segments, t, ordered=True))
    assert got[0].valid and not got[100].valid and not got[102].valid and not got[103].valid
    shuffled = chat.format_conversations(df).repartition(5, "segment", "text")
    read(rows, chat.read_back(shuffled))
    assert chat.read_back(chat.format_conversations(df.limit(0)), ordered=True).count() == 0
    assert segments.where("loss AND text LIKE '%q%'").isEmpty()


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    read(rows, queries.op7_chat(spark, SF))
