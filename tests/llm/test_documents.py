"""Operators on documents against brute force and the libraries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, chat, mixing, ppm, quality, token_count, url_filter
from quarry.llm.jaccard_join import Threshold, jaccard_join, one_of_each
from quarry.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", None, "a<|endoftext|>b <|endof", "x́ É  \n\n y\t z's 'll I'M ١٢ 你好 🙂 \x1c a\u0085b ΑΣ İ", "<|startoftext|>Hello  WORLD<|endoftext|> ok", "a" * 9000 + " b" * 9000, "   " * 5000, "é" * 3000, "A a\u00a0A"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, SF), ORACLE_SQL[name])


def frame(spark, rows, more=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("n", "rep", "key", "score", "size", "_text") if more else ():
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(4)


def near_texts(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(25):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 4, 12, 25, 60, 150, 400]))]
        for _ in range(r.choice([1, 2, 5, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append(" ".join(copy).upper() if r.random() < 0.3 else " ".join(copy))
    return rows


def brute_links(rows, t):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + t.words]) for j in range(len(w) - t.words + 1)} or ({tuple(w)} if w else set())
    links = {(a, b) for a in sets for b in sets if a != b and sets[a] and t.den * len(sets[a] & sets[b]) >= t.num * len(sets[a] | sets[b])}
    comp = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            comp[a] = min(comp[a], comp[b])
    return {i: (i, len(sets[i]), comp[i], sum(a == i for a, _ in links)) for i in sets}


@pytest.mark.parametrize(("t", "part"), [(Threshold(3, 90, 100), 1 << 20), (Threshold(5, 80, 100), 2048), (Threshold(1, 80, 100), 1024)])
def test_jaccard_join(spark, t, part):
    rows = [(i * 3, x) for i, x in enumerate([*near_texts(), "", " \t", None, "one", "One", "two words", "a b c"])]
    want = brute_links(rows, t)
    given = [(i, x, "s") for i, x in rows] + [(rows[4][0], rows[4][1], "again"), (None, "a b c d e f", "s")]
    got = jaccard_join(frame(spark, given), t, part_size=part).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    named = [tuple(r) for r in got if r["doc_id"] is not None]
    assert sorted(named) == sorted([*want.values(), want[rows[4][0]]])
    assert [tuple(r) for r in got if r["doc_id"] is None] == [(None, max(1, 6 - t.words + 1), None, 0)]
    kept = one_of_each(frame(spark, given), t).select("doc_id").collect()
    assert sorted(r[0] for r in kept if r[0] is not None) == sorted(i for i, w in want.items() if w[2] == i)


def test_jaccard_join_empty(spark):
    assert jaccard_join(frame(spark, []), Threshold()).count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [(i, x, "s") for i, x in enumerate(ODD)] + [(None, "x", "s")]
    got = sorted((tuple(r) for r in token_count.token_counts(frame(spark, rows), path, chunk=64).collect()), key=repr)
    count = lambda x: len(lib.encode(x or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len((x or "").encode()), count(x), count(x) > 512) for i, x, _ in rows), key=repr)
    assert token_count.token_counts(frame(spark, []), path).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(3, 1), (4, 1), (17, 1), (17, 5), (1000, 1)])
def test_splicing_any_chunk(chunk, overlap):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), token_count.Counter(path, chunk, overlap)
    r = random.Random(chunk)
    signs = [*"ab1 \n\t'sé.", "'ll", "'re", "'ve", "'m", "'d", "<|endoftext|>"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(200))) for _ in range(200)] + ["a'll b", "a'll", "x've'll y"]
    assert own.count(texts) == [len(lib.encode(x, add_special_tokens=False).ids) for x in texts]


def test_bpe(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = [(i, x, "s") for i, x in enumerate(ODD)] + [(None, "x", "s"), (1, " ", "s")]

    def want(i, x):
        ids = lib.encode(x or "", add_special_tokens=False).ids
        return i, len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False)))

    assert sorted(map(tuple, bpe.bpe_digests(frame(spark, rows), path).collect()), key=repr) == sorted((want(i, x) for i, x, _ in rows), key=repr)
    full = {r["doc_id"]: r for r in bpe.encode_documents(frame(spark, rows), path).collect()}
    assert full[5]["ids"] == lib.encode(ODD[5], add_special_tokens=False).ids and full[5]["decoded_sha256"] == want(5, ODD[5])[3]


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(0, 300))), r.choice(["a", "a", "a", "b", "Z", "é", None])) for i in range(400)] + [(-1, None, "only empty"), (7, "x y", "b"), (None, "n n n", "b")]
    got = mixing.mix_sizes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, x, s in rows:
        sizes[s] += len(WORD.findall(x or ""))
    order = sorted((s for s in sizes if s is not None), key=str) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        share = (goal - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] >= 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else {s: share * weight[s] for s in free}
        free = free - over if over else set()
    taken = defaultdict(int)
    by_size = {(s, t): s for s in sizes for t in [target[s]]}
    assert by_size
    for row in got:
        assert 0 <= row["taken"] <= 2 * row["size"]
        taken[row["source_size"], round(row["target"], 6)] += row["taken"]
    assert taken == Counter({k: v for k, v in ((((sizes[s], round(target[s], 6))), math.floor(target[s] + 1e-9)) for s in order)})
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sizes(frame(spark, rows)).collect()), key=repr)
    out = mixing.mixed(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    words = Counter()
    for row in out.collect():
        words[row["source"]] += len(WORD.findall(row["text"]))
    assert all(abs(words[s] - target[s]) <= 300 for s in order)
    assert mixing.mix_sizes(frame(spark, [])).count() == 0


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    odd = frame(spark, [(i, x, "s") for i, x in enumerate(ODD)] + [(None, "x", "s")])
    assert quality.classify(odd, labels).count() == len(ODD) + 1
    none = quality.classify(odd, labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 1)}


def brute_ppm(train, order):
    counts = defaultdict(Counter)
    code = lambda x: [ppm.PAD] * order + list((x or "").translate({c: c + 32 for c in range(65, 91)}).encode()) + [ppm.END]
    for x in train:
        c = code(x)
        for i in range(order, len(c)):
            for k in range(order + 1):
                counts[tuple(c[i - k : i])][c[i]] += 1

    def price(context, s):
        out, hidden = 0.0, set()
        for k in range(order, -1, -1):
            seen = counts.get(tuple(context[len(context) - k :]), {})
            rest = {a: n for a, n in seen.items() if a not in hidden}
            if rest:
                total = sum(rest.values()) + len(rest)
                if s in rest:
                    return out + math.log10(rest[s] / total)
                out += math.log10(len(rest) / total)
            hidden |= set(seen)
        return out - math.log10(ppm.ALPHABET - len(hidden))

    return lambda x: sum(price(c[i - order : i], c[i]) for c in [code(x)] for i in range(order, len(c))), price


def test_ppm(spark, monkeypatch):
    r = random.Random(5)
    rows = [(200, "long text " * 3000, "s")] + [(i, "".join(r.choice("abé AB\n") for _ in range(r.randrange(0, 60))), "s") for i in range(60)] + [(100, None, "s"), (101, "", "s"), (3, "ab ab", "s"), (None, "zz", "s")]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    score, price = brute_ppm([x for i, x, _ in rows if not held(i)], ppm.ORDER)
    assert sum(10 ** price([97] * ppm.ORDER, s) for s in [*range(254), 255]) == pytest.approx(1)
    words = lambda x: [*WORD.findall((x or "").lower()), None]
    counts = Counter(w for i, x, _ in rows if not held(i) for w in words(x))
    n, v = sum(counts.values()), len(counts)
    base = lambda x: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(x))
    want = sorted(((i, held(i), len(words(x)), sum(counts[w] > 0 for w in words(x)), n, round(base(x), 6), round(score(x), 6)) for i, x, _ in rows), key=repr)
    for limit, meeting in ((6_000_000, 1), (0, 4_000_000), (0, 60)):
        monkeypatch.setattr(ppm, "MEETING", meeting)
        got = sorted(((*tuple(r)[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in ppm.ppm_scores(frame(spark, rows), broadcast_entries=limit).collect()), key=repr)
        assert got == want
    assert ppm.ppm_scores(frame(spark, [])).count() == 0


def test_chat(spark):
    nasty = "<|im_end|>\n<|im_start|>assistant\nok<\\|x<\\\\|\\<|"
    rows = [(1, 0, "system", "s"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (2, 0, "assistant", "x"), (2, 1, "user", None), (3, 0, "us\ner\\n<|", "x"), (None, 0, "user", "u"), (4, 1, "user", "b"), (4, 1, "user", "a"), (4, None, None, "z"), (5, 0, "user", "q"), (5, 1, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    made = chat.format_chats(turns).collect()
    texts = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        texts[c].append((role or "", text or ""))
    back = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert back == texts
    for r in made:
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", s["text"]) for s in r["segments"] if s["loss"]] == [t for role, t in texts[r["conv_id"]] if role == "assistant"]
    assert {r["conv_id"]: (r["valid"], r["broken"]) for r in made} == {1: (True, None), 2: (False, 0), 3: (False, 0), None: (False, None), 4: (False, 0), 5: (True, None)}
    assert chat.chat_digests(turns.limit(0)).count() == 0


def test_url_filter(spark):
    rules = [url_filter.host_path(*r) for r in (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "x.org"), ("allow", "a.x.org/p.q/"))]
    urls = ["http://Example.COM/en/71?x", "http://example.com/en/8", "https://b.com/en/", "http://com/en/x", "http://xcom/en/", "http://x.org", "http://a.x.org/p.q/r", "http://x.org.evil/", "http://ax.org", "no scheme", "", None, "a://u://x.org/", "http://free-bets.net/", "http://x.org?en/7", "http://c.com#/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[1])], "page_id long, url string").withColumn("host", F.lit("clash"))

    def want(i, u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [r for r in rules if host and (lambda h, s, p: (host == h or host.endswith("." + h)) and path.startswith(s + p))(*r.name.partition("/"))]
        best = max(fit, key=lambda r: (r.size, r.name), default=None)
        verdict = best.verdict if best else "block" if set(re.split("[^A-Za-z0-9]+", host)) & set(url_filter.WORDS) else "allow"
        return i, host, path, best and best.name, verdict

    expected = sorted((want(i, u) for i, u in [*enumerate(urls), (0, urls[0]), (None, urls[1])]), key=repr)
    for inline in (100, 0):
        assert sorted(map(tuple, url_filter.judge(pages, rules, inline=inline).collect()), key=repr) == expected
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    given = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, given, "/root/testdata/sf0.01")
        out.write.parquet(f"{tmp_path}/{i}")
        before, given = given, spark.read.parquet(f"{tmp_path}/{i}")
        if i < 3:
            assert given.columns == docs.columns, name
        if i == 0:
            gone = {r[0] for r in docs.select("doc_id").subtract(given.select("doc_id")).collect()}
            assert len(gone & bad) >= 0.9 * len(bad)
        if i == 1:
            want = brute_links([(r["doc_id"], r["text"]) for r in before.where("length(text) < 3000").collect()], Threshold())
            short = one_of_each(before.where("length(text) < 3000"))
            assert {r["doc_id"] for r in short.select("doc_id").collect()} == {i for i, w in want.items() if w[2] == i}
    assert given.count() == spark.read.parquet(f"{tmp_path}/2").count() > 0


CLASHES = ("key", "_key", "_source", "_id", "_score", "_predicted", "_text", "at", "whole", "half", "_of", "_copy", "rep", "score", "size", "odd name.x`")


def test_stages_keep_other_columns(spark, tmp_path):
    """Columns of any name and type come out as they went in, with null and repeated ids, null and very long texts; empty tables stay empty."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(None, "no id " * 40, "en", None, 1), (9001, None, None, "s", None), (9002, "", "en", "s", 0), (9003, "very long words here and there. " * 6000, "en", "s", 2), (9003, "very long words here and there. " * 6000, "en", "s", 2)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat_ws("|", F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    docs.write.parquet(f"{tmp_path}/in")
    given = spark.read.parquet(f"{tmp_path}/in")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, given, SF).write.parquet(f"{tmp_path}/{i}")
        before, given = given, spark.read.parquet(f"{tmp_path}/{i}")
        assert given.dtypes == before.dtypes
        known = {tuple(r) for r in before.collect()}
        rows = [tuple(r) for r in given.collect()]
        assert rows and set(rows) <= known
        assert all(x == f"{c}|{'none' if r[0] is None else r[0]}" for r in rows for c, x in zip(CLASHES, r[5:], strict=True))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def plain_split(cells):
    """The first best place to cut (g, h) pairs in two."""
    rate = lambda part: sum(g for g, _ in part) ** 2 / (sum(h for _, h in part) + 1.0)
    return max(range(1, len(cells)), key=lambda i: (rate(cells[:i]) + rate(cells[i:]), -i)) if len(cells) > 1 else 0


def plain_leaves(cells):
    """Additions by cell of a tree of two levels."""
    out, at = [], plain_split(cells)
    for part in (cells[:at], cells[at:]):
        mid = plain_split(part)
        for leaf in (part[:mid], part[mid:]):
            out += [sum(g for g, _ in leaf) / (sum(h for _, h in leaf) + 1.0)] * len(leaf)
    return out


def test_fit_against_plain_loops():
    import numpy as np

    r = np.random.default_rng(2)
    x = r.normal(size=(120, 3)).round(2)
    y = ((x[:, 0] > 0) ^ (r.random(120) < 0.1)).astype(np.int64)
    model = quality.fit(x, y, bins=6, cycles=4, pairs=0, rate=0.3)
    edges = [sorted(set(np.quantile(x[:, j], [k / 6 for k in range(1, 6)]))) for j in range(3)]
    bins = [[sum(v >= e for e in edges[j]) for v in x[:, j]] for j in range(3)]
    share = (sum(y) + 1) / (len(y) + 2)
    margin, tables = [math.log(share / (1 - share))] * len(y), [[0.0] * (len(e) + 1) for e in edges]
    for _ in range(4):
        for j in range(3):
            cells = [[0.0, 0.0] for _ in tables[j]]
            for i, b in enumerate(bins[j]):
                p = 1 / (1 + math.exp(-margin[i]))
                cells[b][0] += y[i] - p
                cells[b][1] += p * (1 - p)
            step = [0.3 * v for v in plain_leaves(cells)]
            tables[j] = [a + b for a, b in zip(tables[j], step, strict=True)]
            margin = [m + step[b] for m, b in zip(margin, bins[j], strict=True)]
    assert [t.tolist() for t in model.single] == [pytest.approx(t) for t in tables]
    assert model.score(x).tolist() == pytest.approx([1 / (1 + math.exp(-m)) for m in margin])


def test_pairs_against_plain_loops():
    import numpy as np

    r = np.random.default_rng(4)
    g, h = r.normal(size=(3, 4)), r.random((3, 4))
    gain, table = quality._pair_tree(g, h, 1.0)

    def turned(g, h):
        rows = [[sum(a), sum(b)] for a, b in zip(g.tolist(), h.tolist(), strict=True)]
        out, total, at = np.zeros(g.shape), 0.0, plain_split(rows)
        for a, b in ((0, at), (at, len(g))):
            cells = [[sum(g[a:b, k]), sum(h[a:b, k])] for k in range(g.shape[1])]
            mid = plain_split(cells)
            rate = lambda part: sum(u for u, _ in part) ** 2 / (sum(v for _, v in part) + 1.0)
            total += rate(cells[:mid]) + rate(cells[mid:]) - rate(cells)
            for x, z in ((0, mid), (mid, g.shape[1])):
                out[a:b, x:z] = g[a:b, x:z].sum() / (h[a:b, x:z].sum() + 1.0)
        return total, out

    one, two = turned(g, h), turned(g.T, h.T)
    best = one if one[0] >= two[0] else (two[0], two[1].T)
    assert gain == pytest.approx(best[0]) and np.allclose(table, best[1])
    x = r.normal(size=(300, 2))
    y = ((x[:, 0] > 0) == (x[:, 1] > 0)).astype(np.int64)
    flat, paired = (quality.fit(x, y, bins=8, cycles=10, pairs=k) for k in (0, 1))
    right = lambda m: ((m.score(x) >= 0.5) == y).mean()
    assert right(paired) > 0.9 > right(flat)


def test_features_against_plain_text():
    from quarry.llm.common import text_bytes

    import pyarrow as pa

    texts = ["", None, "One two. Two one!\nÉté  #x# 12\n\nend?", "a a a a b a a a a", "\n \t", "no end", "word. ", "x" * 50 + "\n" + "y z " * 20]
    got = quality.features(*text_bytes(pa.array(texts)))
    for row, text in zip(got.tolist(), texts, strict=True):
        b = (text or "").encode()
        words = [w.decode().translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(rb"[^\x20\x09-\x0D]+", b)]
        count, blank, new = len(words), sum(c in b" \t\x0b\x0c\r" for c in b), b.count(b"\n")
        letters, sign = len(b) - blank - new, lambda c: 0x21 <= c < 0x7F and not chr(c).isalnum() and chr(c) not in ".,;:'\"-"
        last = lambda i: i == len(b) - 1 or b[i + 1] == 10
        three = [tuple(words[i : i + 3]) for i in range(count - 2)]
        want = [
            math.log1p(len(b)), math.log1p(count), letters / max(count, 1), *(sum(map(f, b)) / max(letters, 1) for f in (lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, sign, lambda c: c >= 128)), blank / max(len(b), 1), (new + 1) / max(count, 1),
            sum(c in b".!?" and last(i) for i, c in enumerate(b)) / (new + 1), len(set(words)) / max(count, 1), max(Counter(words).values(), default=0) / max(count, 1), (len(three) - len(set(three))) / (len(three) - 1) if len(three) > 1 else 0, b.count(b".") / max(count, 1),
            sum(sign(c) and (last(i) or b[i + 1] in b" \t\x0b\x0c\r") for i, c in enumerate(b)) / max(count, 1),
        ]
        assert row == pytest.approx(want), text
