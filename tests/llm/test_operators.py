"""The corpus operators against brute force, on odd rows and on empty tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablemend.llm import licenses, lines, packing, token_file, top_products
from tablemend.llm.decontaminate import clean, contamination
from tablemend.llm.graph import components
from tablemend.llm.language import Automaton, Parser, languages
from tablemend.llm.licenses import license_notices
from tablemend.llm.near_copies import near_copies, signatures
from tablemend.llm.skew import attach
from tablemend.llm.store import scratch
from tablemend.llm.tokens import Encoder, default_vocabulary
from tablemend.llm.toxicity import toxicity
from tablemend.llm.warc import read_archive, write_archive

FOLDER = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_whole_texts():
    random.seed(4)
    letters = "ab C'\n\t  .,1é日\xa0\x85 s"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(800)]
    letters = "ab'strem12²½_-é—“…\u2028 \n日ªº.,"
    texts += ["".join(random.choice(letters) for _ in range(random.randint(0, 30))) for _ in range(2000)]
    texts += ["it's  we'll\n\n x", " <|endoftext|> a", "a\x1cb \x1d c", "", None, "\n a", "a \n"]
    encode = Encoder(default_vocabulary(), keep=50)
    assert [np.frombuffer(r, "<u4").tolist() for r in encode(texts)] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("size", [1, 64, 1 << 20])
def test_token_file(spark, docs, size):
    path = scratch(spark, "tokens")
    token_file.write_token_file(docs, path, segment_tokens=size)
    found = sorted(token_file.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, 11, 12]
    text = {r.doc_id: r.text for r in docs.collect()}
    start, everything = 0, []
    for r in found:
        ids = [*ids_of(text[r.doc_id]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start, everything = start + len(ids), everything + ids
    wanted = [0, 1, start - 1, start // 2, start // 3, start, -1]
    got = token_file.read_tokens(spark.createDataFrame([(p,) for p in wanted], "position bigint"), path)
    assert rows_of(got) == sorted(((p, everything[p]) for p in wanted if 0 <= p < start), key=str)


def test_levels_round_trip():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 1 << b, 700) for b in (3, 8, 9, 17, 25, 32)]).astype(np.uint32)
    rng.shuffle(ids)
    levels = token_file.split_levels(ids)
    assert len(levels) == 4 and (token_file.join_levels(levels) == ids).all()
    at = rng.integers(0, len(ids), 500)
    assert (token_file.ids_at(levels, at) == ids[at]).all()


def test_top_products(spark):
    random.seed(2)
    rows = [(i, [random.gauss(0, 1) * random.choice([0.1, 1, 5]) for _ in range(random.choice([4, 4, 3, 0]))]) for i in range(300)]
    rows += [(1000 + i, [3.0, 1.0, 0.0, 2.0]) for i in range(100)] + [(i, [x - 1 for x in v]) for i, v in rows[:5]]
    rows += [(2000, None), (2020, [1.0, None]), (2040, [math.nan]), (2060, [math.inf]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    rows += [(3000, [4e7, 1.0]), (3001, [1e8, -1e8, 3.0]), (3002, [0.5, 0.25]), (3020, [0.0, 0.0]), (3040, [1e8, 1e8, 7.0]), (3003, [1e300])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    held = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wanted = []
    for a, (q, v) in enumerate(held):
        if q % 20 == 0:
            whole = [(sum(x * y for x, y in zip(v, w, strict=False)), i) for b, (i, w) in enumerate(held) if b != a]
            scores = [(-max(-(1 << 63), min((1 << 63) - 1, s)), i) for s, i in whole]
            wanted += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:20])]
    for sizes in ({"bucket": 32, "tile": 2, "block": 8}, {}):
        assert rows_of(top_products.top_products(df, **sizes)) == sorted(wanted, key=str)
    assert top_products.top_products(df.filter("vec_id < 0")).count() == 0


def test_queries_meet_tiles_by_reach(spark, monkeypatch):
    """Queries meet tiles by reach, looked up in steps of tiles."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8) * (20 if i % 50 == 1 else 1)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(top_products, "LENGTHS", 5)
    found = top_products.top_products(df, k=5, bucket=16, tile=2, block=10)
    held = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    for q in (0, 400, 1980):
        scores = sorted((-sum(x * y for x, y in zip(held[q][1], w, strict=True)), i) for i, w in held if i != q)[:5]
        assert [(r.rank, r.vec_id, -r.score) for r in sorted(found.filter(f"query_id = {q}").collect(), key=lambda r: r.rank)] == [(k + 1, i, s) for k, (s, i) in enumerate(scores)]


def test_top_products_prunes_by_coordinates():
    rng = np.random.default_rng(3)
    rows = rng.integers(-64, 64, (400, 8))
    norms = np.sqrt((rows**2).sum(1))
    rows, norms = rows[np.argsort(-norms)], np.sort(norms)[::-1]
    pruned = 0
    for query in rng.integers(-64, 64, (50, 8)):
        score = rows @ query
        floor = int(np.sort(score)[-5])
        at = top_products.search((rows, norms, rows / norms[:, None]), query, float(np.sqrt((query**2).sum())), floor)
        assert set(np.flatnonzero(score >= floor)) <= set(at)
        pruned += len(rows) - len(at)
    assert pruned > 0


def brute_near(rows, percent=75):
    sets = defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i].append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    return sets, least


def test_near_copies(spark, docs, none):
    random.seed(5)
    base = [f"w{k}" for k in range(120)]
    rows = [(100, " ".join(base))]
    for i in range(101, 160):
        words = rows[random.randrange(len(rows))][1].split()
        for _ in range(random.randint(0, 3)):
            words[random.randrange(len(words))] = f"n{random.randrange(1000)}"
        rows.append((i, " ".join(words)))
    more = spark.createDataFrame(rows, "doc_id bigint, text string")
    both = docs.filter("doc_id is not null").select("doc_id", "text").union(more)
    sets, least = brute_near([tuple(r) for r in both.collect()])
    wanted = [(r.doc_id, len(sets[r.doc_id][0]), least[r.doc_id], least[r.doc_id] == r.doc_id) for r in both.collect()]
    assert rows_of(near_copies(both)) == sorted(wanted, key=str)
    assert rows_of(near_copies(docs.filter("doc_id is null"))) == [(None, 2, None, True)]
    assert near_copies(none).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    for size in (3, 60, 5000):
        pool = rng.integers(0, 1 << 63, 3 * size, dtype=np.uint64)
        one, two = np.unique(pool[: 2 * size]), np.unique(pool[size:])
        marks = signatures([one, two, one[:0]])
        assert (marks[2] == 0xFFFFFFFF).all() and (marks[:2] < 0xFFFFFFFF).all()
        assert abs((marks[0] == marks[1]).mean() - 1 / 3) < 0.2


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 200), (300, 200), (7, 7)]
    found = rows_of(components(spark.createDataFrame(chain, "u bigint, v bigint")))
    assert found == sorted([(i, 0) for i in range(51)] + [(i, 100) for i in (100, 200, 300)], key=str)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_attach_splits_frequent_keys(spark):
    rows = spark.range(6000).selectExpr("case when id < 4000 then 0 else id % 50 end as k", "id")
    values = spark.range(40).selectExpr("id as k", "id * 2 as v")
    for how in ("inner", "left"):
        assert rows_of(attach(rows, values, "k", most=3, how=how).select("k", "id", "v")) == rows_of(rows.join(values, "k", how).select("k", "id", "v"))


def test_drop_lines(docs, none):
    found = {(r.doc_id, r.score): r for r in lines.drop_lines(docs).collect()}
    assert found[9, 8].n_dropped == 0 and found[9, 8].n_lines == 3
    assert found[10, 9].text == "a\nb  c\r\n d" and found[10, 9].n_dropped == 1
    assert found[1, 0].n_dropped == 0 and found[2, 1].text == "" and found[3, 2].text == ""
    assert found[4, 3].text is None and found[4, 3].n_lines == 0 and found[5, 4].text == ""
    assert found[None, 10].text == "no name for this one here"
    assert lines.drop_lines(docs).count() == docs.count() and lines.drop_lines(none).count() == 0


def test_templates_generalise(spark):
    texts = [f"user {n} logged in from {h} today" for n, h in ((1, "home"), (22, "work"), (3, "home"))] + ["user seven went home from work today"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.n_dropped for r in sorted(lines.drop_lines(df).collect())] == [0, 1, 1, 0]


def test_language(spark, docs, none):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = {r.doc_id: r for r in languages(df).collect()}
    truth = {r.doc_id: r.lang for r in df.collect()}
    held = [i for i, r in found.items() if r.held_out]
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == r.held_out for i, r in found.items())
    assert sum(found[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    odd = {r.doc_id: r for r in languages(docs).collect()}
    assert [odd[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in odd.values())
    assert languages(none).count() == 0
    assert {r.lang_pred for r in languages(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_automaton_knows_substrings():
    random.seed(1)
    for _ in range(40):
        texts = [bytes(random.choice(b"ab") for _ in range(random.randint(1, 12))) for _ in range(3)]
        step = Automaton(bytes([255]).join(texts)).step
        for size in range(1, 6):
            for bits in range(2**size):
                part, state = bytes(b"ab"[(bits >> k) & 1] for k in range(size)), 0
                for byte in part:
                    state = step[state].get(byte, -1) if state >= 0 else -1
                assert (state >= 0) == any(part in t for t in texts)


def test_packing(docs, none):
    found = packing.pack(docs, size=64, task_rows=3).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in found:
        ids = [*ids_of(text[r.doc_id]), 0]
        assert r.ids_crc32 == crc(ids[r.start : r.start + r.length]) and (r.length == 64 or r.piece == 0)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:], strict=False)) and sum(n for _, n in b) <= 64
    assert sum(r.length for r in found) == sum(len(ids_of(r.text)) + 1 for r in docs.collect())
    assert packing.pack(none).count() == 0


def test_plan_is_best_fit():
    random.seed(6)
    counts = {n: random.randint(1, 9) for n in random.sample(range(1, 65), 30)}
    space, opened = [], 0
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fits = [k for k in range(opened) if space[k] >= n]
            if fits:
                space[min(fits, key=lambda k: space[k])] -= n
            else:
                space.append(64 - n)
                opened += 1
    runs = packing.plan(counts, 64)
    used = {first + k for _, a, b, first, each, _ in runs for k in range(-(-(b - a) // each))}
    assert used == set(range(opened))
    for n in counts:
        covered = sorted((a, b) for m, a, b, *_ in runs if m == n)
        assert covered[0][0] == 0 and covered[-1][1] == counts[n] and all(x[1] == y[0] for x, y in zip(covered, covered[1:], strict=False))


def test_toxicity(spark, docs, none):
    folder = FOLDER.replace("0.001", "0.01")
    df, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = {r.doc_id: r for r in toxicity(df, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == r.held_out and r.predicted == (r.score >= 0.7) for i, r in found.items())
    held = [(t, found[i].predicted) for i, t in truth.items() if i in found and found[i].held_out]
    assert sum(p for t, p in held if t == 0) <= 2 and sum(p for t, p in held if t == 1) >= 0.5 * sum(t for t, _ in held)
    odd = rows_of(toxicity(docs, labels.filter("doc_id < 0")))
    assert len(odd) == docs.count() and all(0 <= r[2] < 0.7 and r[3] == 0 for r in odd)
    assert toxicity(none, labels).count() == 0


@pytest.mark.parametrize("split", ["128m", "600b"])
def test_warc(spark, split):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "WARC/1.0\r\n"), (4, "a\nb", inner), (5, None, inner), (6, "x", inner + inner + "é")]
    rows += [(7, "x", "y" + inner + "WARC/1.0\r\n"), (None, "x", "q"), (8, "x", "q"), (9, "x", "r" * 3000), (9, "x", "r" * 3000), (10, "u", "\r\n\r\n")]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = scratch(spark, "archive")
        write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(2), path)
        found = read_archive(spark, path).collect()
        empty = scratch(spark, "archive")
        write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), empty)
        assert read_archive(spark, empty).count() == 0
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    most = defaultdict(lambda: -1)
    for i, _, h in rows:
        most[h or ""] = max(most[h or ""], -1 if i is None else i)
    wanted = []
    for i, _, h in rows:
        raw, top = (h or "").encode(), most[h or ""]
        again = i != top
        wanted.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(wanted, key=str)
    assert all(r.intact for r in found)


def test_phrases_equal_brute_force(monkeypatch):
    """Longest matches one after the other; foreign bytes are phrases, and blocks end them."""
    rng = random.Random(3)
    for block in (512, 5):
        monkeypatch.setattr("tablemend.llm.language.BLOCK", block)
        for _ in range(60):
            learnt = [(x, bytes([255]).join(bytes(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(3))) for x, letters in (("a", b"abc "), ("b", b"bcd"))]
            texts = [bytes(rng.choice(b"abcd z") for _ in range(rng.randint(1, 30))) for _ in range(8)]
            wanted = []
            for t in texts:
                row = []
                for _, known in learnt:
                    parts, n = known.split(bytes([255])), 0
                    for at in range(0, len(t), block):
                        rest = t[at : at + block]
                        while rest:
                            k = max([k for k in range(1, len(rest) + 1) if any(rest[:k] in p for p in parts)], default=1)
                            rest, n = rest[k:], n + 1
                    row.append(n)
                wanted.append(row)
            assert Parser(learnt).phrases(texts).tolist() == wanted


def test_contamination(spark, docs, none):
    items = [(1, "Word5x1 word6x2 WORD7x2 word8x2 word9x3 word10x3 word11x3 word12x4 word13x4 word14x4 word15x5"), (2, "one TWO"), (3, None), (4, "..."), (20, "two three"), (5, "Köln"), (None, "gap here"), (5, "Grüße aus")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wanted = []
    for i, t in ((r.doc_id, r.text) for r in docs.collect()):
        w, hit, names = split(t), set(), set()
        for name, text in items:
            x = split(text)
            m = min(10, len(x))
            for k in range(len(x) - m + 1 if m else 0):
                for at in range(len(w) - m + 1):
                    if w[at : at + m] == x[k : k + m]:
                        hit |= set(range(at, at + m))
                        names |= {str(name)} if name is not None else set()
        wanted.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    for block in (4_000_000, 5):
        assert rows_of(contamination(docs, table, block_chars=block)) == sorted(wanted, key=str)
    assert {r.n_hit for r in contamination(docs, table.filter("item_id < 0")).collect()} == {0}
    assert contamination(none, table).count() == 0


def test_clean_acts_on_rows(spark):
    """A hit row goes with or without doc_id, a clean row that shares its doc_id stays."""
    item = " ".join(f"w{k}" for k in range(12))
    rows = [(None, f"x {item}", 1), (1, f"y {item}", 2), (2, "clean text", 3), (2, item, 4), (None, "clean as well", 5), (3, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, marks int")
    items = spark.createDataFrame([(1, item), (2, "none of these")], "item_id bigint, text string")
    for block in (4_000_000, 5):
        assert sorted(r.marks for r in clean(docs, items, block_chars=block).collect()) == [3, 5, 6]
    assert clean(docs, items.filter("item_id < 0")).count() == 6


def test_license_notices(spark, docs, none):
    rows = [(1, "x " * 37 + "Licensed under the APACHE license, version 2.0. " + "y " * 50), (2, "All rights reserved"), (3, "all rights"), (4, None), (5, "")]
    rows += [(6, "Released under the MIT License; released, under the mit license"), (6, "licensed under cc by-nc 4.0")]
    found = rows_of(license_notices(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "license_id", "containment"))
    assert found == [(1, "Apache-2.0", 1.0), (2, "all-rights-reserved", 1.0), (6, "CC-BY-NC-4.0", 1.0), (6, "MIT", 1.0)]
    assert license_notices(docs).count() == 0 and license_notices(none).count() == 0


def test_clashing_columns(spark, docs):
    import corpus_pipeline

    extra = docs.selectExpr("*", "score as drop", "score as n_dropped", "score as hash", "score as component", "score as label", "score as leader", "score as maybe", "score as key", "score as toxicity", "score as marks", "score as _items")
    before = sorted(extra.columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        extra = stage(spark, extra, FOLDER)
        assert sorted(extra.columns) == before and extra.count() > 0


def brute_lines(rows, depth=3, similarity=0.8, least=5, letters=12):
    """Pairs of lines are compared word by word: they share a template if they agree outside one field."""

    def cut(line):
        words = line.split()
        fields = ["<*>" if re.search(r"\d", w) else w for w in words]
        masked = len(words) >= least and fields.count("<*>") * 2 <= len(words)
        return fields if masked else words

    def alike(a, b):
        if len(a) != len(b) or a[:depth] != b[:depth]:
            return False
        figures = [[w for w in x if re.search(r"\d", w) and not re.search(r"[^\W\d_]", w)] for x in (a, b)]
        n, free = len(a), round(len(a) * (1 - similarity) - 0.499)
        if figures[0] != figures[1]:
            return False
        if n >= least and free:
            for k in range(depth, n, free):
                gap = ["<*>"] * min(free, n - k)
                c = [*a[:k], *gap, *a[k + free :]]
                if c == [*b[:k], *gap, *b[k + free :]] and c.count("<*>") * 2 <= n:
                    return True
        return a == b

    lines_ = [(d, cut(x)) for d, t in rows if d is not None for x in (t or "").split("\n")]
    lines_ = [(d, w) for d, w in lines_ if len(w) >= least or sum(map(len, w)) >= letters]
    out = []
    for d, t in rows:
        kept = []
        for x in (t or "").split("\n") if t else []:
            w = cut(x)
            takes = d is not None and (len(w) >= least or sum(map(len, w)) >= letters)
            if not (takes and any(e < d and alike(w, v) for e, v in lines_)):
                kept.append(x)
        n = len(t.split("\n")) if t else 0
        out.append((d, "\n".join(kept) if n > len(kept) else t, n, n - len(kept)))
    return sorted(out, key=str)


def test_drop_lines_equals_brute_force(spark):
    rng = random.Random(7)
    word = lambda: rng.choice("abcd") + rng.choice(["", "", "", "7"])
    line = lambda: " ".join(["the", rng.choice("xy"), "is", *(word() for _ in range(rng.choice([0, 1, 2, 3, 7, 8, 13])))])
    rows = [(rng.choice([i, i // 2, None]) if i % 4 == 0 else i, "\n".join(line() for _ in range(rng.randint(1, 6)))) for i in range(150)]
    rows += [(200, "unbroken日本語のテキスト"), (201, "unbroken日本語のテキスト"), (202, ""), (203, None), (204, "\n\n"), (205, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, maybe int").repartition(5)
    found = lines.drop_lines(df).select("doc_id", "text", "n_lines", "n_dropped")
    got = rows_of(found)
    assert got == brute_lines(rows) and sum(r[3] for r in got) > 100


def test_templates_of_many_lines(spark):
    """One leaf with thousands of lines: a field that is another in each makes one template, whatever their number."""
    rows = [(i, f"Posted by user {chr(97 + i % 26)}{'xyzuv'[i // 26 % 5]}{'q' * (i // 130)} on the forum today") for i in range(6000)]
    found = lines.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("n_dropped = 0").collect()
    assert [r.doc_id for r in found] == [0]


def test_figures_and_short_lines(spark):
    """Different rows of figures stay, equal ones and short recurring lines go."""
    texts = ["12 34 56 78 90\n1.5 2.5 3.5 4.5 5.5", "5 6 7 8 9", "12 34 56 78 91", "12 34 56 78 90", "この記事の無断転載を固く禁じます", "この記事の無断転載を固く禁じます"]
    texts += ["Chapter 12 Introduction", "Chapter 13 Introduction", "All rights reserved", "all\nAll rights  reserved", "all"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.n_dropped for r in sorted(lines.drop_lines(df).collect())] == [0, 0, 0, 1, 0, 1, 0, 0, 0, 1, 0]


def test_close_licenses(spark):
    """Licenses that differ in a word are told apart, and license texts are found."""
    work = "This work is licensed under the GNU {}General Public License, version {}".format
    texts = [work("", 3), work("", 2), work("Lesser ", 3), work("Affero ", 3), "This work is licensed under the Free General Public License, version 3"]
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License".format
    texts += [cc(""), cc("-NonCommercial"), cc("-ShareAlike"), cc("-NonCommercial-ShareAlike"), cc("-Other")]
    mit = dict(licenses.TEXTS)["MIT"]
    texts += [mit, mit.replace("the above copyright notice", "the copyright notice"), " ".join(mit.split()[:40])]
    texts += ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."]
    found = license_notices(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.license_id) for r in found.collect()) == [
        *enumerate(["GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0"]), *enumerate(["CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC-BY-NC-SA-4.0"], 5),
        (10, "MIT"), (11, "MIT"), (13, "LGPL-3.0"),
    ]


def test_packing_remembers_fewer_words_than_the_encoder_may():
    import pyarrow as pa

    from tablemend.llm import packing, worker

    batch = pa.record_batch([pa.array([1], pa.int64()), pa.array(["some words"])], ["doc_id", "text"])
    assert len(list(packing._pieces(iter([batch]), default_vocabulary(), 0, 2048))) == 1
    encoder = worker._HELD["encoder"][1]
    assert encoder.words.keep <= 100_000 and encoder.pieces.keep <= 25_000
