"""Leaderboard changes, tokenizer alignment and source mixing beside SQL and plain versions."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from oracle import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from argusframe.llm import alignment, leaders, mixing, packing

LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, batch string, h string, nation_id string"
ITEMS, VENDORS = "item_id long, name string, price double, listed int", "vendor_id long, name string, nation_id int, item_id long"


def plain_feed(lines, items, vendors):
    """The change feed by replaying every line."""
    price, nation = {}, {}
    for i, _, p, _ in items:
        if i is not None:
            price[i] = max([x for x in (price.get(i), p) if x is not None], default=None)
    for v, _, n, _ in vendors:
        if v is not None:
            nation[v] = max([x for x in (nation.get(v), n) if x is not None], default=None)
    rows = []
    for sale, line, item, vendor, quantity, amount, _, flag, at, *_ in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, line)).encode())
        s = (at.date().toordinal() - 719163) if at is not None else 19723 + h % 150
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        cents = int(100 * amount + 0.5) if amount is not None else quantity * int(100 * price[item] + 0.5) if quantity is not None and price.get(item) is not None else 0
        rows.append((min(10, max(1, 1 + (a - 19723) * 10 // 180)), a, s, nation.get(vendor) if item in price else None, item, -cents if flag == "returned" else cents))
    revenue, boards, out, seen = defaultdict(int), defaultdict(dict), [], None
    for batch in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == batch]
        for day in sorted({r[1] for r in own}):
            for _, _, _, n, item, cents in (r for r in own if r[1] == day and r[3] is not None and (seen is None or r[2] + 3 >= seen)):
                revenue[n, item] += cents
            for n in {k[0] for k in revenue}:
                best = sorted((-v, i) for (m, i), v in revenue.items() if m == n and v > 0)[:10]
                now = {i: k + 1 for k, (_, i) in enumerate(best)}
                for i in now.keys() | boards[n].keys():
                    old, new = boards[n].get(i), now.get(i)
                    if old != new:
                        out.append((n, day, i, batch, "enter" if old is None else "exit" if new is None else "move", old, new, revenue[n, i]))
                boards[n] = now
        seen = max([r[2] for r in own] + ([] if seen is None else [seen]))
    return sorted(out, key=repr)


def test_leaders_equal_a_replay_of_odd_tables(spark):
    from datetime import datetime, timedelta

    rng = random.Random(5)
    items = [(i, None, rng.choice([None, 1.0, 2.5]), 1) for i in range(14)] + [(None, "x", 1.0, 0), (3, "again", 9.0, 1)]
    vendors = [(v, None, rng.choice([None, 0, 1]), v) for v in range(6)] + [(None, None, 1, 1), (2, "again", 1, 1)]
    pick = lambda values: rng.choice([None, *values])
    lines = [
        (pick(range(9)), pick(range(4)), rng.choice([*range(16), None, 3, 3, 3]), pick(range(8)), pick(range(5)), rng.choice([None, 0.5, 2.25, 7.0, 3.0]), None, rng.choice(["kept", "returned", None, "kept"]),
         rng.choice([None, datetime(2023, 12, 28, 7), *[datetime(2024, 1, 1) + timedelta(days=rng.randint(0, 170)) for _ in range(4)]]), "x", "y", "z")
        for _ in range(600)
    ]
    lines += lines[:40]
    tables = [spark.createDataFrame(rows, schema) for rows, schema in ((lines, LINES), (items, ITEMS), (vendors, VENDORS))]
    got = sorted((tuple(r) for r in leaders.change_feed(*tables).collect()), key=repr)
    want = plain_feed(lines, items, vendors)
    assert got == want and {r[4] for r in want} == {"enter", "exit", "move"}


def test_leaders_of_empty_tables(spark):
    none = [spark.createDataFrame([], schema) for schema in (LINES, ITEMS, VENDORS)]
    assert leaders.change_feed(*none).count() == 0
    line = spark.createDataFrame([(1, 1, 1, 1, 1, 1.0, None, "kept", None, "", "", "")], LINES)
    assert leaders.change_feed(line, *none[1:]).count() == 0


def plain_alignment(rows):
    model, tokenizer, byte = sentencepiece.SentencePieceProcessor(model_file=RIGHT), Tokenizer.from_file(LEFT), packing.byte_symbols()
    tokenizer.encode_special_tokens = True
    piece = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    told, count, top = [], Counter(), defaultdict(int)
    for doc_id, text in rows:
        spaced = " " + (text or "")
        ids = (tokenizer.encode(spaced, add_special_tokens=False).ids, model.encode(text)) if text else ([], [])
        tokens = [bytes(byte[c] for c in tokenizer.id_to_token(i)) for i in ids[0]], [piece(i) for i in ids[1]]
        if not text or any(b"".join(t) != spaced.encode() for t in tokens):
            told.append((doc_id, 0, 0, [], Counter()))
            continue
        spans = []
        for side in tokens:
            at, own = 0, []
            for t in side:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        groups, links = [], Counter()
        for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            before = groups[-1][0] if groups else 0
            groups.append((cut, *[[i for i, (s, e) in enumerate(own) if before <= s and e <= cut] for own in spans]))
            for p in groups[-1][1]:
                for q in groups[-1][2]:
                    links[ids[0][p], ids[1][q]] += max(spans[0][p][0], spans[1][q][0]) < min(spans[0][p][1], spans[1][q][1])
        links = +links
        count.update(links.keys())
        told.append((doc_id, len(ids[0]), len(ids[1]), [",".join(str(ids[0][p]) for p in g[1]) + "|" + ",".join(str(ids[1][q]) for q in g[2]) for g in groups], links))
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return sorted(
        (
            (d, a, b, len(g), sum(k.values()), sum(m for pair, m in k.items() if count[pair] == top[pair[0]]), sum(m * count[pair] for pair, m in k.items()), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for d, a, b, g, k in told
        ), key=repr,
    )


@pytest.mark.parametrize("heavy", [0, 300, 1 << 16])
def test_alignment_equals_definition(spark, heavy):
    texts = [r.text[:400] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect() if r.text]
    odd = [None, "", " ", "  a  ", "<|endoftext|> a<s></s>", "x▁y", "漢字 ¡é\x00\n\n z ", "naïve\tcafé 12345 'll", "a" * 3000, "the the the", "the the the"]
    rows = list(enumerate([*texts, *odd])) + [(None, "no id"), (1, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "links": F.lit("x")}).repartition(3)
    got = alignment.align_documents(df, LEFT, RIGHT, heavy).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_alignment(rows)


def test_alignment_and_mixing_of_odd_and_empty_tables(spark, odd, none):
    assert alignment.align_documents(none, LEFT, RIGHT).count() == 0 and alignment.align_documents(odd, LEFT, RIGHT).count() == odd.count()
    with_source = lambda df: df.withColumns({"source": F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))), "place": F.lit(0), "rest": F.lit("x"), "_source": F.lit("y")})
    assert mixing.mix(with_source(none)).count() == 0
    rows = mixing.mix(with_source(odd)).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r.size for r in rows)


def test_mixing_reaches_targets_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").when(F.col("doc_id") % 50 == 1, None).otherwise(F.col("source")))
    runs = [sorted(map(tuple, mixing.mix(d).collect()), key=repr) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1]
    by = defaultdict(int)
    for _, size, source_size, target, taken in runs[0]:
        assert 0 <= taken <= 2 * size
        by[source_size, target] += taken
    total = sum(r[1] for r in runs[0])
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    assert all(abs(taken - target) <= 1 and target <= 2 * size + 1e-9 for (size, target), taken in by.items())


def test_mixing_without_words_and_all_capped(spark):
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2
    one = spark.createDataFrame([(1, "a b c d", "a")], "doc_id long, text string, source string")
    assert mixing.mix(one).first().taken == 6 and mixing.mix(one, share=9.0).first().taken == 8


def test_packing_takes_the_second_library_for_plain_files_only(tmp_path):
    with open(LEFT, encoding="utf-8") as file:
        spec = json.load(file)
    assert packing.LibraryIds(LEFT).fast is not None
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        ids = packing.LibraryIds(str(path))
        assert ids.fast is None and ids("Hello World").tolist() == Tokenizer.from_file(str(path)).encode("Hello World", add_special_tokens=False).ids
