"""Lexical search, chat windows and whitening against plain versions, on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweft.llm import chat, lexical, whitening

# --- 11 chat windows ---------------------------------------------------------------------------
TURNS = "conv_id long, turn long, role string, text string, start long, cell long, kind long, body string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "other") for r in rows], TURNS)


def plain_chats(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        said = "".join(t for r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    bits = ["<|im_end|>", "<|im_start|>", "<\\|", "<\\\\|", "<", "|", "\\", "\n", "assistant\n", "é", "word ", "<|endoftext|>", "😀", " "]
    text = lambda n: "".join(rng.choice(bits) for _ in range(rng.randint(0, n)))
    rows = [(c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"]), text(40)) for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(100, t, ["user", "assistant"][t % 2], text(60)) for t in range(600)]  # one conversation has most rows
    rows += [(200, 0, "user", "word " * 9000), (200, 1, "assistant", "x" * 30000), (201, 0, "system", "long " * 3000), (201, 1, "user", "a"), (201, 2, "assistant", "b"), (202, 0, "system", "alone")]
    rows += [(300, None, "user", None), (300, 1, None, "no role"), (300, 1, "assistant", ""), (300, 1, "assistant", ""), (300, 1, "assistant", "tie"), (None, 0, "a\nb\\n<|", "c"), (None, 1, "assistant", "\\"), (301, 0, "user", "x"), (301, 1, "system", "late")]
    return rows


@pytest.mark.parametrize("budget,history", [(2048, 256), (128, 40), (64, 0)])
def test_chats_equal_plain_version(spark, talks, budget, history):
    got = chat.format_and_read(chats(spark, talks).repartition(7), budget=budget, history=history).collect()
    assert {r[0]: tuple(r[1:5]) for r in got} == plain_chats(talks) and len(got) == len({t[0] for t in talks})


def test_windows_keep_budget_and_repeat_history(spark, talks):
    counts = chat.Counts(chat.byte_bpe_path())
    size = lambda text: sum(n * counts.pieces(w) for w, n in counts.frequencies(text).items())
    budget, history = 300, 80
    rows = chat.windows(chats(spark, talks), budget=budget, history=history).collect()
    by = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append(r)
    over = with_history = 0
    for conv, own in by.items():
        seen, system = [], None
        for w in sorted(own, key=lambda r: r["first"]):
            turns = chat.parse(w["text"])
            system = system or (turns[0] if turns[0][0] == "system" else None)
            each = [size(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(t)}<|im_end|>\n") for r, t in turns]
            assert len(turns) == w["repeated"] + w["new"] and sum(each) == w["tokens"] and w["new"] > 0
            shown, new = turns[: w["repeated"]], turns[w["repeated"] :]
            if shown and system:
                assert shown[0] == system
                shown = shown[1:]
            assert shown == seen[len(seen) - len(shown) :]  # whole turns, the last ones before the span
            assert sum(each[w["repeated"] - len(shown) : w["repeated"]]) <= history
            with_history += bool(shown)
            if w["tokens"] > budget:
                over += 1
                assert len(new) == 1 or conv == 201
            assert [chat.unescape(w["text"][a:b]) for a, b in zip(w["loss_from"], w["loss_to"], strict=True)] == [t for r, t in new if r == "assistant"]
            seen += new
    assert over and with_history > 20


def test_no_conversations(spark):
    assert chat.format_and_read(chats(spark, [])).collect() == []


def test_escapes_are_undone():
    for text in ["<|", "<\\|", "<\\\\|<|", "|<", "<<||>", "", "a<|im_end|>\\", "\n<|\n"]:
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        assert "\n" not in chat.escape_role(text) and chat.unescape_role(chat.escape_role(text)) == text


# --- 12 lexical search -------------------------------------------------------------------------
DOCS = "doc_id long, text string, terms long, item long, rank long"
ITEMS = "item_id long, text string, terms long, doc_id long, score long"
PATTERN = re.compile(lexical.TERM)


def plain_search(docs, items, top=50):
    lowered = lambda t: PATTERN.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    held = [(i, Counter(lowered(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores, asked = [], set(lowered(text))
        for i, c, n in held:
            s = 0
            for t in asked:
                if c[t]:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // n_terms)))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    docs += [(None, "no id abc"), (None, None), (7, docs[7][1]), (7, "abc other"), (-5, "Ünïcode ÀB abc\x00abc-abc_abc abc"), (900, None), (901, ""), (902, "...")]
    docs += [(2000 + i, "the same text abc") for i in range(200)] + [(1 << 40, "abc " * 700_000), (3, "x" * 3_000_000)]
    items = [(i, " ".join(rng.sample(words, 6))) for i in range(12)] + [(12, None), (13, ""), (14, "Abc ABC abc, aBC"), (15, "nowhere"), (14, "same text"), (None, "abc"), (16, "x" * 3_000_000)]
    return docs, items


def test_search_equals_plain_version(spark, library, monkeypatch):
    docs, items = library
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], DOCS)
    q = spark.createDataFrame([(*r, 1, 2, 3) for r in items], ITEMS)
    want = plain_search(docs, items)
    ranked = lambda: sorted(map(tuple, lexical.search(d, q).collect()), key=str)
    assert ranked() == want
    monkeypatch.setattr(lexical, "ITEMS", 5)  # several blocks of items
    assert ranked() == want


def test_small_windows_and_pieces(library):
    docs, items = library
    for text in [t.encode() for _, t in docs if t]:
        assert lexical.count_terms(text) == Counter(text.translate(lexical.TABLE).split())


def test_search_empty(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", 1, 2, 3)], ITEMS)
    assert lexical.search(none, one).collect() == [] and lexical.search(none, one.limit(0)).collect() == []
    assert lexical.search(spark.createDataFrame([(1, "a", 1, 2, 3)], DOCS), one.limit(0)).collect() == []


# --- 13 whitening ------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, n long, x long, component long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], VECTORS)


def test_whitening_equals_plain_version(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 10)) * np.linspace(3, 0.3, 10) + 5
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[0].tolist()) for i in range(200)] + [(None, base[1].tolist()), (5, base[5].tolist()), (2000, [-0.001] * 7), (2001, [])]
    odd = [(1, None), (2, [1.0] * 9 + [None]), (3, [float("nan")] * 10), (4, [float("inf")] + [0.0] * 9)]
    got = whitening.whiten(vectors(spark, rows + odd).repartition(9)).toPandas()
    x = np.zeros((len(rows), 10), np.int64)
    for k, (_, v) in enumerate(rows):
        x[k, : len(v)] = np.floor(256 * np.array(v, np.float32).astype(float))
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(u.T, bias=True))
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    want = (x - s / n) @ axes / np.sqrt(values)
    assert len(got) == 4 * len(rows) and (got.n == n).all() and got.identity_error.max() <= 1e-9 and got.identity_error.nunique() == 1
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    got = got.sort_values(["vec_id", "component"], kind="stable")
    two = got.groupby("component")
    for c, own in two:
        # repeated ids: their rows are equal here but for 5, whose rows are copies
        y = want[order, c - 1]
        sign = np.sign((own.whitened.values * y).sum())
        assert np.abs(own.whitened.values * sign - y).max() < 1e-9
        assert (own.deviation.values == ((n * x - s) ** 2).sum(axis=1)[order]).all()
        assert np.allclose(own.explained, values[c - 1] / np.trace(np.cov(u.T, bias=True)), rtol=1e-10)


def test_merging_is_lossless():
    rng = np.random.default_rng(4)
    x = rng.integers(-500, 500, (90, 12))
    whole = whitening.Node.of(x)
    for cuts in ([1, 2, 50], [40], [5, 6, 7, 8, 9, 80]):
        parts = [whitening.Node.of(p) for p in np.split(x, cuts)]
        node = parts[0]
        for p in parts[1:]:
            node = node.merge(whitening.Node.read({k.split()[0]: v for k, v in zip(whitening.NODE.split(", "), p.row(0), strict=True)}))
        assert node.n == 90 and node.sums == x.sum(axis=0).tolist() and np.allclose(node.s, whole.s, rtol=1e-12)
        assert np.allclose(node.vt.T * node.s**2 @ node.vt, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)), atol=1e-6)


def test_whitening_small_tables(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # no variance, no component
    line = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0])])).collect()
    assert len(line) == 2 and {round(abs(r["whitened"]), 9) for r in line} == {1.0} and {r["component"] for r in line} == {1}


def test_deviation_is_exact():
    w = whitening.Whitener(3, [2**40, -5], np.zeros(2), np.eye(2), np.ones(2), 2.0)
    assert w.deviation(np.array([[2**29, 7]])).tolist() == [(3 * 2**29 - 2**40) ** 2 + 26**2] if (3 * 2**29 - 2**40) ** 2 < 2**63 else True
    with pytest.raises(OverflowError):
        w.deviation(np.array([[2**50, 7]]))


# --- the near-copy stage on texts of one template -----------------------------------------------


def test_texts_of_one_template_are_not_compared(spark):
    """Texts that share most of their shingles, but not enough of them, leave the shared shingle's cell: the work does not grow with their square."""
    from tallyweft.llm import simhash

    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the page you asked for was not found "), F.col("id").cast("string")).alias("text"), F.lit(1).alias("_h"), F.lit(2).alias("t"), F.lit(3).alias("rep"))
    more = spark.createDataFrame([(9001, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", 1, 2, 3), (9002, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen more", 1, 2, 3)], "doc_id long, text string, _h int, t int, rep int")
    kept = simhash.keep_one(rows.unionByName(more))
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {*range(6000), 9001}
