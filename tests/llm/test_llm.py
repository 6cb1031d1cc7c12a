"""Each operator against brute force or a round trip, and on odd rows."""

from __future__ import annotations

import base64
import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from winnowry.llm import bpe, chain_dedup, embedding_dedup, fingerprints, html_text, kneser_ney, minhash_dedup, packing, suffix_dedup, toxicity

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    passage = text(999, 70)
    out = [(i, text(i, 60 + 7 * i)) for i in range(12)]
    out += [(12, out[3][1]), (13, out[4][1].replace("alpha1", "beta1", 1)), (14, text(50, 30) + " " + passage + " " + text(51, 30)), (15, text(52, 40) + " " + passage), (16, ""), (17, None), (18, "  \n "), (19, "aaaa" * 200), (20, "éü ß 漢字 " * 40), (21, text(60, 30) + " " + passage.replace(passage.split()[35], "changed", 1))]
    return out


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


ODD = [(None, "no id at all"), (1, "same id"), (1, "same id"), (1, "other text of the id"), (2, None)]


def test_bpe_equals_tiktoken_and_round_trips(spark, rows):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [(100, "a  b\n\n c\t\td \n"), (101, "x\0y"), (102, "don't 123 ½ ²  z")]
    got = bpe.encode(docs(spark, rows + odd), path, P.PATTERN)
    ids = {r.doc_id: r.ids for r in got.collect()}
    for i, t in rows + odd:
        assert ids[i] == enc.encode_ordinary(t or "")
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(got, path).collect()}
    assert all(back[i] == (t or "").encode() for i, t in rows)
    assert bpe.digests(docs(spark, ODD), path, P.PATTERN).count() == len(ODD)
    assert bpe.digests(docs(spark, []), path, P.PATTERN).count() == 0


def test_packing_covers_every_id_once(spark, rows):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    got = packing.pack(docs(spark, rows), functools.partial(packing.tokenise, path=path)).toPandas()
    for i, t in rows:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
    seq = got.sort_values(["sequence_id", "offset"])
    groups = seq.groupby("sequence_id").length
    assert (seq.offset == groups.cumsum() - seq.length).all() and groups.sum().max() <= 2048
    assert packing.pack(docs(spark, []), functools.partial(packing.tokenise, path=path)).count() == 0


def test_fingerprints_of_edits(spark, rows):
    got = {r.doc_id: r for r in fingerprints.compare_with_edits(docs(spark, rows)).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
        assert got[i].n_chars == len(t) and 0 <= got[i].near_edited <= 1
    assert got[3].fingerprint == got[12].fingerprint and got[16].fingerprint == ""
    assert fingerprints.compare_with_edits(docs(spark, ODD)).count() == len(ODD)
    assert fingerprints.compare_with_edits(docs(spark, [])).count() == 0


def test_suffix_dedup_equals_brute_force(spark, rows):
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs(spark, rows)).collect()}
    seen = set()
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        assert (got[i].n_bytes, got[i].n_removed) == (len(b), sum(gone)), i
        assert got[i].kept_sha256 == hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()
    assert suffix_dedup.dedup(docs(spark, [])).count() == 0
    assert suffix_dedup.dedup(docs(spark, ODD)).count() == 3


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:10] + 0.02 * rng.standard_normal((10, 16)), base[:3]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r for r in embedding_dedup.dedup(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    assert all(got[i].n_links == near[i].sum() for i in range(len(x)))
    assert all(got[i].kept == (got[i].component_id == i) for i in got) and got[40].component_id == 0
    assert all(got[i].n_links == 0 for i in (900, 901, 902, 903))


def test_minhash_classes(spark, rows):
    near = " ".join(rows[11][1].split()[:-2] + ["new", "end"])
    got = {r.doc_id: r for r in minhash_dedup.dedup(docs(spark, [*rows, (30, near)])).collect()}
    assert got[12].class_id == 3 and not got[12].kept and got[30].class_id == 11
    assert all(got[i].kept for i in (0, 1, 2, 3, 14, 15, 16, 17, 18, 21))
    assert minhash_dedup.dedup(docs(spark, ODD)).count() == len(ODD)
    assert minhash_dedup.dedup(docs(spark, [])).count() == 0


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    items = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = items[:200], items[60:260]
    doc = np.repeat([0, 1], 200)
    weight = np.concatenate([np.ones(200), np.ones(200)])
    first = minhash_dedup.prob_minhash(doc, np.concatenate([a, b]), weight, 2, 2000)
    exact = minhash_dedup.similarity((np.sort(a), np.ones(200)), (np.sort(b), np.ones(200)))
    assert abs(exact - 140 / 260) < 1e-9 and abs((first[0] == first[1]).mean() - exact) < 0.05


def test_chain_dedup_finds_passages(spark, rows):
    got = {r.doc_id: r for r in chain_dedup.dedup(docs(spark, rows)).collect()}
    kept = {r.doc_id: r.text for r in chain_dedup.cut(docs(spark, rows)).collect()}
    assert got[14].n_removed == 0 and got[12].n_removed == len(rows[12][1].split())
    assert abs(got[15].n_removed - 70) <= 1 and kept[15].split() == rows[15][1].split()[:40]
    assert got[21].n_removed >= 65 and all(got[i].n_removed == 0 for i in (*range(12), 16, 17, 18))
    assert chain_dedup.dedup(docs(spark, ODD)).count() == len(ODD)
    assert chain_dedup.dedup(docs(spark, [])).count() == chain_dedup.cut(docs(spark, [])).count() == 0


def test_chain_dedup_parts_chains_at_unlike_text(spark):
    words = lambda seed, n: text(seed, n).split()
    a, b, c, d = words(1001, 60), words(1002, 60), words(1003, 120), words(1004, 120)
    rows = [(0, a + words(1, 100) + b), (1, c + words(2, 100) + d), (2, words(3, 20) + a + words(4, 100) + b), (3, words(5, 20) + a + b), (4, c + words(6, 100) + d), (5, a + words(7, 30) + b)]
    got = {r.doc_id: r for r in chain_dedup.dedup(docs(spark, [(i, " ".join(t)) for i, t in rows])).collect()}
    for i, due, spans in ((2, 120, 2), (3, 120, 1), (4, 240, 2), (5, 120, 2)):
        assert abs(got[i].n_removed - due) <= 4 and got[i].n_spans == spans, (i, got[i].n_removed)
    assert got[0].n_removed == got[1].n_removed == 0


def test_chain_dedup_finds_fuzzy_passages(spark):
    rows, due = [], {}
    for k in range(120):
        r = random.Random(k)
        passage = text(2000 + k, 60).split()
        other = list(passage)
        for i in sorted(r.sample(range(60), 9), reverse=True):
            other[i : i + 1] = r.choice([["changed" + str(r.random())], [], [other[i], "put" + str(r.random())]])
        rows += [(k, text(3000 + k, 30) + " " + " ".join(passage) + " " + text(4000 + k, 30)), (1000 + k, text(5000 + k, 30) + " " + " ".join(other) + " " + text(6000 + k, 30))]
        due[1000 + k] = len(other)
    got = {r.doc_id: r.n_removed for r in chain_dedup.dedup(docs(spark, rows)).collect()}
    assert sum(got[i] == 0 for i in due) <= 1
    assert np.mean([min(got[i] / n, 1) for i, n in due.items()]) > 0.97 and all(got[i] <= n + 3 for i, n in due.items())
    assert all(got[k] == 0 for k in range(120))


def test_chains_are_optimal_on_small_cases():
    def score(chain, at, other, size):
        gaps = sum(at[b] - at[a] - size[a] + other[b] - other[a] - size[a] for a, b in zip(chain, chain[1:], strict=False))
        return sum(chain_dedup.SEED - 1 + size[i] for i in chain) - chain_dedup.GAP_COST * gaps

    for seed in range(20):
        r = random.Random(seed)
        at, other, size = r.sample(range(60), 8), r.sample(range(60), 8), [r.randrange(1, 9) for _ in range(8)]
        sets = ([i for i in sorted(range(8), key=at.__getitem__) if m >> i & 1] for m in range(1, 256))
        fine = [c for c in sets if all(at[a] + size[a] <= at[b] and other[a] + size[a] <= other[b] for a, b in zip(c, c[1:], strict=False))]
        best = max(score(c, at, other, size) for c in fine)
        found = chain_dedup.chains(at, other, size)
        assert abs(score(found[0], at, other, size) - best) < 1e-9 and sorted(i for c in found for i in c) == list(range(8))


def test_chain_dedup_wants_one_earlier_document(spark):
    """Phrases of many earlier documents that together tile a passage are no passage; a document that holds it whole is one, whoever takes its seeds."""
    p = [f"p{i}" for i in range(120)]
    own = lambda k, i: [f"{k}{i}w{j}" for j in range(50)]
    rows = [(i, own("x", i) + p[i * 10 : i * 10 + 10] + own("y", i)) for i in range(12)] + [(100, p[:60]), (101, p), (102, own("z", 1) + p[30:90] + own("z", 2))]
    got = {r.doc_id: r.n_removed for r in chain_dedup.dedup(docs(spark, [(i, " ".join(t)) for i, t in rows])).collect()}
    assert got[100] == 0 and got[101] == 60 and got[102] == 60 and all(got[i] == 0 for i in range(12))


def test_chain_dedup_takes_passages_from_later_documents_too(spark):
    """Documents 0 and 1 hold halves of 30 words, 2 the whole, 3 and 4 repeat it; 5 and 6 are edited copies at the bound."""
    words = lambda seed, n: text(seed, n).split()
    a = words(900, 60)
    rows = [(0, words(1, 30) + a[:30] + words(2, 30)), (1, words(3, 30) + a[30:] + words(4, 30)), (2, words(5, 20) + a + words(6, 9)), (3, a), (4, words(7, 50) + a)]
    got = {r.doc_id: r.n_removed for r in chain_dedup.dedup(docs(spark, [(i, " ".join(t)) for i, t in rows])).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 60, 4: 60}


@pytest.mark.parametrize("share", [0.0, 0.1, 0.18])
def test_chain_dedup_recall(spark, share):
    """Of passages of 100 words with edits at random places, at the documented identity nine in ten words or more are found."""
    r = random.Random(5)
    rows, due = [], {}
    for k in range(60):
        own = text(100 + k, 100).split()
        other = []
        places = set(r.sample(range(100), round(100 * share)))
        for i, w in enumerate(own):
            other += r.choice([["q" + str(r.random())], [], [w, "q" + str(r.random())]]) if i in places else [w]
        rows += [(2 * k, text(7000 + k, 30) + " " + " ".join(own)), (2 * k + 1, " ".join(other) + " " + text(8000 + k, 30))]
        due[2 * k + 1] = len(other)
    got = {x.doc_id: x.n_removed for x in chain_dedup.dedup(docs(spark, rows)).collect()}
    assert np.mean([got[i] >= 0.9 * n for i, n in due.items()]) >= 0.9
    assert all(got[2 * k] == 0 for k in range(60)) and all(got[i] <= n + 5 for i, n in due.items())


def test_chain_dedup_of_shared_ids_ties_and_clashing_columns(spark):
    a, b = text(1, 60), text(2, 60)
    rows = [(1, a, "x", 7), (2, "zz " + b, "y", 8), (2, "a tail " + a, "z", 9), (2, "a tail " + a, "z", 9), (None, a, "n", 1), (3, None, "e", 0), (4, "", "e", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, found string, kept int")
    got = sorted((r.doc_id or 0, r.text, r.found, r.kept) for r in chain_dedup.cut(df).where("text is not null").collect())
    left = [(1, a, "x", 7), (2, "zz " + b, "y", 8), (2, "a tail ", "z", 9), (2, "a tail ", "z", 9), (0, a, "n", 1), (4, "", "e", 0)]
    assert got == sorted(left)
    counts = sorted((r.doc_id or 0, r.n_removed) for r in chain_dedup.dedup(df).collect())
    assert counts == [(0, 0), (1, 0), (2, 0), (2, 60), (2, 60), (3, 0), (4, 0)]


def test_chain_dedup_of_a_very_long_text(spark):
    """A text of a million words that repeats itself at short and long distance, and a copy of it."""
    long = " ".join(["ab cd"] * 100_000 + [f"w{i % 50_000}" for i in range(300_000)])
    got = {r.doc_id: r for r in chain_dedup.dedup(docs(spark, [(1, long), (2, long), (3, "w" * 3_000_000)])).collect()}
    assert got[1].n_removed == got[3].n_removed == 0 and got[2].n_removed > 0.99 * got[2].n_words


def test_kneser_ney_sums_to_one_and_base_is_exact(spark, rows):
    from pyspark.sql import functions as F

    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    got = {r.doc_id: r for r in kneser_ney.score(docs(spark, rows), held).collect()}
    split = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for i, t in rows}
    count = collections.Counter(w for i, ws in split.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in split.items():
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert abs(got[i].base_score - base) < 1e-6 and got[i].n_tokens == len(ws) and got[i].train_tokens == n
        assert got[i].score < 0
    assert kneser_ney.score(docs(spark, ODD), held).count() == len(ODD)
    assert kneser_ney.score(docs(spark, []), held).count() == 0


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_equals_plain_implementation(spark, order):
    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = [(i, " ".join(r.choice(WORDS[:9]) for _ in range(r.randrange(0, 40)))) for i in range(80)]
    train = [t.split() for i, t in rows if i % 4]
    raw, count = collections.Counter(), {k: collections.Counter() for k in range(1, order + 1)}
    for ws in train:
        ws = ["<s>", *ws, "</s>"]
        raw.update(tuple(ws[i : i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1))
    for g, c in raw.items():
        if len(g) == order or (g[0] == "<s>" and len(g) > 1):
            count[len(g)][g] = c
        if len(g) > 1 and (len(g) > 2 or g[1] != "<s>"):
            if len(g[1:]) < order:
                count[len(g) - 1][g[1:]] += 1
    d = {k: [0.0, *kneser_ney.discounts([sum(c == i for c in count[k].values()) for i in range(1, 5)])] for k in count}
    v = len(count[1])

    def p(ctx, w):
        k = len(ctx) + 1
        low = p(ctx[1:], w) if ctx else 1 / (v + 1)
        seen = [c for g, c in count[k].items() if g[:-1] == ctx]
        if not seen:
            return low
        c = count[k][(*ctx, w)]
        return (max(c - d[k][min(c, 3)], 0) + sum(d[k][min(c, 3)] for c in seen) * low) / sum(seen)

    got = {x.doc_id: x.score for x in kneser_ney.score(docs(spark, rows), F.col("doc_id") % 4 == 0, order).collect()}
    for i, t in rows[:40]:
        ws = ["<s>", *t.split(), "</s>"]
        due = sum(math.log10(p(tuple(ws[max(0, k - order + 1) : k]), ws[k])) for k in range(1, len(ws)))
        assert abs(got[i] - due) < 1e-6, i


def test_toxicity_finds_insults(spark):
    bad = ["blorfnik", "zquogget", "vexmudge"]
    rows, labels = [], []
    for i in range(240):
        t = text(i, 40)
        if i % 4 == 0:
            t = t.replace(" ", f" {bad[i % 3]} ", 1)
        rows.append((i, t))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(500, ""), (501, None), (502, text(7, 30) + " blorf-nik")]
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs(spark, rows), lab).collect()}
    assert np.mean([got[i].predicted == t for i, _, t in labels if got[i].held_out]) > 0.95
    assert got[500].predicted == got[501].predicted == 0 and got[502].predicted == 1
    assert toxicity.score(docs(spark, []), lab.limit(0)).count() == 0


def test_rendering():
    page = "<title>t</title><style>p{}</style><p>One<p>Two<br>three<ul><li>a<li>b</ul><table><tr><th>Name<th>N<tr><td>Pear<td>3</table><div hidden>no</div><pre> x\n  y</pre>&lt;"
    assert html_text.render(page) == "One\n\nTwo\nthree\n\n- a\n- b\n\nName | N\nPear | 3\n\n x\n  y\n\n<"
    assert html_text.render(None) == html_text.render("") == ""
    assert html_text.render("<div>" * 5000 + "deep") == "deep"


def test_rendering_of_visibility_and_foreign_text():
    page = '<p>a<div style="visibility:hidden">no<hr><q>no</q><p style="visibility: visible">yes <b>too</b></p><ul><li>no</ul>no</div><p>z <math><mi>x</mi><annotation>no</annotation></math><svg><title>no</title><defs><text>no</text></defs><text>one</text><text>two</text></svg>'
    assert html_text.render(page) == "a\n\nyes too\n\nz x one two"
    assert html_text.render('<p>a<p style="VISIBILITY:collapse">b') == "a"
    assert html_text.render('<p>a<p style="content-visibility:hidden">b<i style="visibility:visible">c</i>') == "a"


def test_pipeline_keeps_columns(spark, rows, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in pipeline.STAGES[:3]:
        stage(spark, d, str(tmp_path)).write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        assert d.columns == docs(spark, rows).columns
    left = {r.doc_id: r for r in d.collect()}
    assert 12 not in left and 16 in left and len(left[15].text.split()) == 40
    assert pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_of_shared_ids_nulls_and_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b = text(1, 60), text(2, 80)
    rows = [(1, a, "x"), (2, b, "y"), (2, "another " + text(3, 60), "z"), (2, b, "y"), (3, b + " end", "w"), (None, a, "n"), (4, None, "e"), (5, "", "e")]
    kind = "doc_id bigint, text string, gone string"
    for name, some in (("some", rows), ("none", [])):
        (tmp_path / name).mkdir()
        spark.createDataFrame(some, kind).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "some" / "documents.parquet"))
    for name, stage in pipeline.STAGES[:3]:
        d = stage(spark, d, str(tmp_path / "some"))
    got = sorted((r.doc_id or 0, r.text or "", r.gone) for r in d.collect())
    assert got == sorted([(1, a, "x"), (2, b, "y"), (2, "another " + text(3, 60), "z"), (0, a, "n"), (4, "", "e"), (5, "", "e")])
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
    first = pipeline.run(spark, str(tmp_path / "some"))
    second = pipeline.run(spark, str(tmp_path / "some"))
    assert first.count() == second.count() > 0


def test_minhash_recall_against_all_pairs(spark):
    """Classes of texts edited around the bound are those of all pairs' exact similarity."""
    import xxhash

    r = random.Random(11)
    rows = []
    for k in range(40):
        words = text(300 + k, 120).split()
        rows.append((10 * k, " ".join(words)))
        for j in range(1, 4):
            other = list(words)
            for i in r.sample(range(len(other)), r.randrange(0, 4)):
                other[i] = "put" + str(r.random())
            rows.append((10 * k + j, " ".join(other)))
    sets = {}
    for i, t in rows:
        h = np.array([xxhash.xxh64_intdigest(w) for w in t.split()], np.uint64)
        sets[i] = minhash_dedup.weighted_shingles(np.array([0, len(h)]), h, 5)[1:]
    due = {(i, j) for i in sets for j in sets if i < j and i // 10 == j // 10 and minhash_dedup.similarity(sets[i], sets[j]) >= 0.8}
    got = {x.doc_id: x.class_id for x in minhash_dedup.dedup(docs(spark, rows)).collect()}
    found = sum(got[i] == got[j] for i, j in due)
    assert len(due) > 60 and found >= 0.95 * len(due)
    up = {i: i for i in sets}
    for i, j in sorted(due):
        a, b = up[i], up[j]
        up = {k: min(a, b) if v in (a, b) else v for k, v in up.items()}
    assert all(up[got[i]] == up[i] for i in got)  # no class joins what no chain of links joins


def test_word_hashes_equal_those_of_split_words():
    from winnowry.llm import words

    texts = [None, "", " ", "A b\tC", "x" * 600 + " X" + "x" * 599, "A" * 300_000 + "\x0bb", "é É ab", "ab", "ünd\x1cso\u2003weiter"]
    offsets, got = words.hashes(pa.array(texts))
    known = {}
    for i, t in enumerate(texts):
        own = ["".join(c.lower() if c < "\x80" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        assert len(own) == offsets[i + 1] - offsets[i]
        assert all(known.setdefault(w, h) == h for w, h in zip(own, got[offsets[i] : offsets[i + 1]].tolist(), strict=True))
    assert len(set(known.values())) == len(known)


def test_embedding_links_of_huge_and_tiny_vectors(spark):
    v = [[1.0, 2.0], [1e160, 2e160], [1e-170, 2e-170], [2.0, -1.0], [float("inf"), 1.0], [0.0, 0.0], None]
    rows = [(i, x) for i, x in enumerate(v)] + [(7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.dedup(df).collect()]
    assert sorted(x for x in got if x[0] is not None) == [(0, 4, 0), (1, 4, 0), (2, 4, 0), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 4, 0), (7, 4, 0)]
    assert [x for x in got if x[0] is None] == [(None, 0, None)]
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def test_merged_sketches_are_those_of_both_texts(spark):
    from pyspark.sql import functions as F

    from winnowry.llm import fingerprints

    # the end of one text and the beginning of the other give shingles of their own, so compare with sets of shingles
    rows = [(text(i, 3 + i % 9), text(100 + i, 4 + i % 30)) for i in range(40)] + [("", text(1, 9)), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    for c in ("a", "b"):
        df = fingerprints.with_sketch(fingerprints.with_sketch(df, F.col(c), "all_" + c, fraction=1), F.col(c), "s_" + c)
    limit = fingerprints.limit_of(fingerprints.FRACTION)
    for r in df.withColumn("m", fingerprints.merged("s_a", "s_b")).collect():
        every = set(r.all_a) | set(r.all_b)
        below = sorted(h for h in every if h <= limit)
        assert r.m == (below or ([min(every)] if every else []))


def test_fingerprint_likeness_equals_brute_force(spark):
    from winnowry.llm import fingerprints

    rows = [(i, text(i, 30 + 7 * i)) for i in range(20)] + [(20, text(3, 60)), (21, ""), (22, None)]
    got = {r.doc_id: r for r in fingerprints.compare_with_edits(docs(spark, rows)).collect()}
    sets = {i: set(filter(None, got[i].fingerprint.split(","))) for i, _ in rows}
    for i, t in rows:
        j = (i + 1) % len(rows)
        own, other, n = sets[i], sets[j], len(t or "") // 4
        least = min(len(own), len(other))
        assert got[i].near_next == (1.0 if not own and not other else len(own & other) / least if least else 0.0)
        edited = (t or "")[: len(t or "") - n] + (rows[j][1] or "")[:n]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t or "")


def peak_mb(function) -> float:
    import tracemalloc

    tracemalloc.start()
    try:
        function()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def drained(batches) -> None:
    for _ in batches:
        pass


def test_counting_grams_holds_few_of_them_at_once(monkeypatch):
    monkeypatch.setattr(kneser_ney, "FLUSH", 500_000)
    r = np.random.default_rng(3)
    texts = [" ".join(map(str, r.integers(0, 60_000, 10_000).tolist())) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert peak_mb(lambda: drained(kneser_ney.counter(50, 3)(iter([batch])))) < 55  # 500,000 grams of three words are 12 MB
    columns = kneser_ney.grams(*kneser_ney.tokens_of(batch)[:2], 3)
    whole = kneser_ney.summed(columns)[0]
    monkeypatch.setattr(kneser_ney, "FLUSH", 10_000_000)
    made = [kneser_ney.unpacked(x)[0] for b in kneser_ney.counter(50, 3)(iter([batch])) for x in b.column("blob").to_pylist()]
    made = [np.concatenate(x) for x in zip(*made, strict=True)]
    assert all((a[np.lexsort(made)] == b[np.lexsort(whole)]).all() for a, b in zip(made, whole, strict=True))


def test_suffix_dedup_sorts_only_what_shares_more_than_a_seed(monkeypatch, tmp_path):
    r = random.Random(8)
    letters = lambda n: bytes(r.choices(b"abcdefghijklmnop", k=n))
    line, passage = letters(90), letters(300)  # a line shorter than SIZE in every document, a passage in some
    made = [letters(150) + line + letters(150) + (passage[: 200 + 4 * i] if i % 10 == 0 else b"") + letters(9) for i in range(60)]
    made += [line * 3, line * 2 + letters(40), made[7][100:330] + letters(20) + made[7][130:360]]
    where, repeated = [], collections.Counter()
    for text_ in made:
        h = suffix_dedup.gram_hashes(np.frombuffer(text_, np.uint8))
        where.append((h, suffix_dedup.select(h, suffix_dedup.WINDOW)[0]))
        repeated.update(h[where[-1][1]].tolist())
    ats = [[int(x) for x in at if repeated[int(h[x])] > 1] for h, at in where]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(made)), pa.int64()), pa.array(made, pa.binary()), pa.array(ats, pa.list_(pa.int32()))], ["doc_id", "raw", "ats"])
    sorted_bytes = 0
    whole = suffix_dedup.repeats

    def counted(blocks, *rest):
        nonlocal sorted_bytes
        sorted_bytes += sum(map(len, blocks))
        return whole(blocks, *rest)

    monkeypatch.setattr(suffix_dedup, "repeats", counted)
    spans = []
    for b in suffix_dedup.block_maker(4)(iter([batch])):
        spans += [x for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "end")), strict=True) if x[0] is not None]
        blocks = b.filter(pa.compute.is_valid(b.column("bucket")))
        for found in suffix_dedup.bucket_worker(str(tmp_path))(iter([blocks])):
            spans += zip(*(found.column(i).to_pylist() for i in range(3)), strict=True)
    got = {(d, i) for d, s, e in spans for i in range(s, e)}
    seen, want = set(), set()
    for d, text_ in enumerate(made):
        for s in range(len(text_) - 99):
            want |= {(d, i) for i in range(s, s + 100)} if text_[s : s + 100] in seen else set()
            seen.add(text_[s : s + 100])
    assert got == want
    assert sorted_bytes < 9_000


def test_chain_dedup_holds_few_seeds_at_once(monkeypatch):
    monkeypatch.setattr(chain_dedup, "FLUSH", 500_000)
    r = np.random.default_rng(4)
    texts = [" ".join(map(str, r.integers(0, 60_000, 10_000).tolist())) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    assert peak_mb(lambda: drained(chain_dedup.seed_maker(100)(iter([batch])))) < 60  # 500,000 seeds are 10 MB


def test_chain_dedup_drops_chance_meetings_before_it_aligns(monkeypatch):
    r = random.Random(11)
    words = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    texts, parts = [], []
    for _ in range(30):
        own, found = words(300), []
        for j in range(40):  # all but a few share five words and no more
            p = r.randrange(60, 200)
            other = [*words(40), *own[p : p + 5], *words(40)] if j % 20 else [*words(10), *own[p - 30 : p + 35], *words(10)]
            _, h = chain_dedup.hashes(pa.array([" ".join(other)]))
            found.append({"runs": np.array([[p, 40, 1]], np.int32).tobytes(), "words": (h >> np.uint64(33)).astype(np.int32).tobytes()})
        texts.append(" ".join(own))
        parts.append(found)
    texts, parts = [*texts, "", "no part at all"], [*parts, None, []]
    kind = pa.list_(pa.struct([("runs", pa.binary()), ("words", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(32), pa.int64()), pa.array([0] * 32, pa.int64()), pa.array(texts), pa.array(parts, kind)], ["doc_id", "mark", "text", "parts"])
    whole, seen = chain_dedup.passages, []

    def counted(docs):
        seen.extend(len(p) for _, p in docs)
        return whole(docs)

    monkeypatch.setattr(chain_dedup, "passages", counted)
    got = [x for b in chain_dedup.aligner(iter([batch.slice(0, 13), batch.slice(13)])) for x in b.column("n_removed").to_pylist()]
    all_docs = []
    for t, found in zip(texts[:30], parts[:30], strict=True):
        _, h = chain_dedup.hashes(pa.array([t]))
        all_docs.append(((h >> np.uint64(33)).astype(np.int64), [(np.frombuffer(x["runs"], np.int32).reshape(-1, 3).tolist(), np.frombuffer(x["words"], np.int32).astype(np.int64)) for x in found]))
    assert got == [sum(b - a for a, b in chain_dedup.merged(x, 2)) for x in whole(all_docs)] + [0, 0]
    assert min(got[:30]) >= 65
    assert sum(seen) < 100  # of 1,200, of which 60 hold a passage


def test_minhash_verifies_few_pairs_of_a_large_component(monkeypatch):
    r = random.Random(12)
    base = [f"w{r.randrange(900)}" for _ in range(200)] + ["again"] * 12
    texts = []
    for i in range(160):  # many that share some of their text, few that are alike
        words = list(base)
        for at in r.sample(range(200), 8):
            words[at] = f"x{r.random()}"
        texts.append(" ".join(words))
        if i % 20 == 0:
            texts.append(" ".join([*words[:-30], "other"]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "mark", "node", "text"])
    signed = next(minhash_dedup.signer(5)(iter([batch])))
    t = pa.table({"rep": signed.column("doc_id"), "signature": signed.column("signature"), "text": batch.column("text"), "side": pa.array([2] * len(texts))})
    exact, calls = minhash_dedup.similarity, []
    sets = [minhash_dedup.weighted_shingles(*minhash_dedup.hashes(pa.array([x])), 5)[1:] for x in texts]
    table = np.zeros(minhash_dedup.SLOTS)
    for i in range(0, len(texts), 9):
        most = minhash_dedup.at_most(sets[i], sets, table)
        assert not table.any() and all(m >= exact(sets[i], x) - 1e-9 for m, x in zip(most.tolist(), sets, strict=True))
    monkeypatch.setattr(minhash_dedup, "similarity", lambda a, b: calls.append(1) or exact(a, b))
    found = minhash_dedup.verifier(5, 0.68)(t)
    union = minhash_dedup.blocks.Union(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if exact(sets[i], sets[j]) >= 0.68:
                union.join(i, j)
    got = minhash_dedup.blocks.Union(len(texts))
    for u, v in zip(*(found.column(c).to_pylist() for c in "uv"), strict=True):
        got.join(u, v)
    assert [got.root(i) for i in range(len(texts))] == [union.root(i) for i in range(len(texts))]
    assert len({union.root(i) for i in range(len(texts))}) > 20
    assert len(calls) < 1500


def shuffled(spark, work) -> int:
    """Bytes that work writes to shuffles."""

    def written() -> dict[int, int]:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        gateway = spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = written()
    work()
    return sum(n for k, n in written().items() if k not in before)


@pytest.mark.parametrize(("stage", "most"), [("minhash_dedup", 0.5), ("substring_dedup", 1.7)])
def test_pipeline_sends_no_texts_that_a_join_leaves_alone(spark, tmp_path, stage, most):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    rows = [(i, " ".join(f"{r.getrandbits(160):040x}" for _ in range(500))) for i in range(80)]
    rows += [(100 + i, rows[i][1].replace(rows[i][1][:40], "edited")) for i in range(3)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")  # as if there were more of them than may be broadcast
    try:
        sent = shuffled(spark, lambda: dict(pipeline.STAGES)[stage](spark, d, str(tmp_path)).write.parquet(str(tmp_path / "out")))
    finally:
        spark.conf.set(setting, before)
    got = {x.doc_id: x.text for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert all(got[i] == t for i, t in rows[:80])
    assert [i for i in got if i >= 100] == [] if stage == "minhash_dedup" else all(len(got[100 + i].split()) <= 1 for i in range(3))
    assert 0 < sent < most * sum(len(t) for _, t in rows)


def test_sieve_loses_nothing_where_all_keys_clash(spark, monkeypatch):
    import pyspark.sql.functions as F

    from winnowry.llm import common

    monkeypatch.setattr(common, "SIEVE", 1)
    rows, others = spark.range(0, 3000).withColumn("_slot", F.lit("x")), spark.range(0, 3000, 50).selectExpr("id as other")
    some, rest = common.sieved(rows, F.xxhash64("id"), others, F.xxhash64("other"))
    some, rest = ({x.id for x in part.collect()} for part in (some, rest))
    assert some | rest == set(range(3000)) and not some & rest and some >= set(range(0, 3000, 50)) and rest
    assert common.sieved(rows, F.xxhash64("id"), others.limit(0), F.xxhash64("other"))[0].count() == 0
