"""PII, toxicity and LM scores."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path

from siltstone.llm import attention_lm, pii, toxicity

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return out


def test_base_of_real_and_odd_texts():
    import pyarrow.parquet as pq

    odd = ["a@b.c@d.e", "@x.y", "a@@b.c", "1.2.3.4.5", "1.2.3", "300.1.1.1 1.2.3.4", "0001.2.3.4", "4111 1111-1111 1111", "4111  1111 1111 1111", "+1 (2)", "+49 (0) 123-456-789.", "é@x.yz", "a.b@c-d.e-f.g.", "x" * 5000, "1" * 5000, "+1" + " " * 3000, "1." * 2000, "\U0001f600a@b.cd"]
    for t in odd + pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist():
        want = sorted(plain(t))
        counts, sha, _, _ = pii.inspect(t)
        assert counts == [sum(x[3] == k for x in want) for k in PATTERNS]
        assert sha == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest(), t[:60]


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("write to jane [at] mail [dot] example [dot] com now", "email:9:47"),
        ("jane(at)example.com", "email:0:19"),
        ("ask jane.doe at mail dot example dot com please", "email:4:40"),
        ("jane @ mail . example . com", "email:0:27"),
        ("jаne@exаmple.com", "email:0:16"),
        ("ja​ne@exam​ple.com", "email:0:18"),
        ("call plus one five five five two three four five six seven eight ok", "phone:5:64"),
        ("card four one one one one one one one one one one one one one one one.", "card:5:69"),
        ("４111 1111 1111 1111", "card:0:19"),
        ("host one nine two dot one six eight dot zero dot one up", "ip:5:52"),
        ("call ＋1 555 234 5678", "phone:5:20"),
        ("jane at example dot com", "email:0:23"),
    ],
)
def test_disguises(text, span):
    got = pii.inspect(text)
    assert got[2] == span, (got, text[int(span.split(":")[1]) : int(span.split(":")[2])])


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("j\u043ehn@example.com", "email:0:16,email:2:16"),
        ("jane@example.c\u043em", "email:0:14,email:0:16"),
        ("jane@mail.example [dot] com", "email:0:17,email:0:27"),
        ("john [dot] doe@example.com", "email:0:26,email:11:26"),
        ("+49 170 1234567 eight nine zero", "phone:0:15,phone:0:31"),
        ("jane@example.com", "email:0:16"),
    ],
)
def test_fragments_keep_their_span_and_the_whole_is_added(text, spans):
    counts, sha, got, added = pii.inspect(text)
    assert (got, sum(counts), added) == (spans, 1, spans.count(","))
    assert sha == hashlib.sha256(pii.joined([(a, b, k) for k, s in enumerate(pii.find_base(text)) for a, b in s]).encode()).hexdigest()


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("jane@mail[.]example[.]pt", "email:0:24"),
        ("jane@mail[.]example[.]zzz . Then", "email:0:25"),
        ("jane arroba mail punto mx", "email:0:25"),
        ("jane at mail dot example dot com . Then", "email:0:32"),
        ("4111 1111 1111 11 one one", "card:0:25"),
        ("four one 11 1111 1111 1111", "card:0:26"),
        ("192.168.0 dot one", "ip:0:17"),
        ("plus four nine 170 1234567", "phone:0:26"),
        ("x" * 250 + " [dot] doe@ex[.]com", "email:0:269"),
        ("4111 1111 1111 1111 one", "card:0:19"),
        ("+49 170 1234567 two times", "phone:0:15"),
        ("in 2019 one man", ""),
        ("jane@mail . example.zzz", ""),
    ],
)
def test_sure_disguises_pass_without_a_list(text, spans):
    assert pii.inspect(text)[2] == spans


@pytest.mark.parametrize("text", ["look at the dot matrix", "meet me at example.com", "one two three go", "we are at home. Next", "(at) noon", "a man @ home", "Привет, мир. Как дела", "at at at dot dot", "see [1] and (2)", "sept huit neuf"])
def test_plain_talk_is_left_alone(text):
    assert pii.inspect(text)[2] == ""


def test_private_rows(edge_docs, no_docs, edge_rows):
    got = pii.find_private(edge_docs).collect()
    assert len(got) == len(edge_rows) and all(r.spans == "" for r in got if r.doc_id in (1, 2, 3))
    assert all(r.n_spans == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added == len(r.spans.split(",")) * (r.spans != "") for r in got)
    assert pii.find_private(no_docs).count() == 0


def test_toxicity_learns_held_out_and_pairs(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    caught = [r.predicted for r in rows if r.toxic]
    assert right > 0.97 and sum(caught) > 0.8 * len(caught) and all(0 <= r.score <= 1 for r in rows)
    draw = np.random.default_rng(1)
    texts, y = [], []
    for _ in range(1500):  # two words that are harmful together only
        a, b = (draw.random(2) < 0.5).tolist()
        texts.append(toxicity.text_terms(b" ".join([b"insult"] * a + [b"group"] * b + [b"w%d" % k for k in draw.integers(0, 40, 6)])))
        y.append(float(a and b))
    m = toxicity.train(texts, np.array(y))
    assert m.score(b"insult group w1") > 0.5 > max(m.score(b"insult w1"), m.score(b"group w1"))


def test_toxicity_edges(spark, edge_docs, no_docs, edge_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(edge_docs, none).collect()} == {toxicity.train([], np.zeros(0)).score(b"")}
    odd = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (12, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(edge_docs, odd).count() == len(edge_rows)
    assert toxicity.toxicity(no_docs, odd).count() == 0
    assert toxicity.reject_toxic(edge_docs, none).columns == edge_docs.columns


def test_lm_base_and_totals(edge_docs, edge_rows, no_docs):
    file = path("word_bpe_49k.json")
    got = attention_lm.score_texts(edge_docs, file).collect()
    words = lambda t: (t or "").encode().lower().split()
    trained = [(i, t) for i, t in edge_rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for _, t in trained for w in words(t))
    n, v = sum(c.values()) + len(trained), len(c) + 1
    want = Counter()
    for i, t in edge_rows:
        w = words(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(trained) + 1) / (n + v + 1))
        want[(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 4))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert attention_lm.score_texts(no_docs, file).count() == 0


def test_lm_mixture_is_a_distribution_and_sees_each_id_once():
    draw = np.random.default_rng(2)
    common = draw.random(50)
    m = attention_lm.Model.drawn(common / common.sum(), 0)
    assert np.allclose(m.table.sum(axis=0), 1, atol=1e-4)
    lengths = np.array([1, 5, 16, 17, 40, 100])
    ids = draw.integers(0, 50, lengths.sum())
    assert m.windows(ids, lengths)[2].sum() == lengths.sum()
    got = m.log_probabilities(ids, lengths)
    at = 0
    for n in lengths:  # place by place
        own, total, g = ids[at : at + n], 0.0, got[at : at + n].sum()
        for t in range(n):
            w = max(0, -(-(t + 1 - attention_lm.WINDOW) // attention_lm.STRIDE)) * attention_lm.STRIDE
            before = [own[k - 1] if k else 0 for k in range(w, t + 1)]
            mix = m.forward(np.array([before + [0] * (attention_lm.WINDOW - len(before))]))["mix"][len(before) - 1]
            total += np.log10(float(mix @ m.table[own[t]]))
        assert abs(total - g) < 1e-2
        at += n


def test_lm_gradients():
    draw = np.random.default_rng(4)
    m = attention_lm.Model.drawn(np.full(30, 1 / 30), 0)
    inputs, t = draw.integers(0, 30, (3, 16)), draw.integers(0, 30, 48)
    loss = lambda: -np.log((m.forward(inputs)["mix"] * m.table[t]).sum(axis=1)).sum()
    f = m.forward(inputs)
    joint = f["mix"] * m.table[t]
    slopes = {k: np.zeros(s, np.float32) for k, s in m.SHAPES.items()}
    m._slopes(f, f["mix"] - joint / joint.sum(axis=1, keepdims=True), slopes)
    for name in m.SHAPES:
        flat, g = getattr(m, name).reshape(-1), slopes[name].reshape(-1)
        k = int(np.argmax(np.abs(g)))
        old, e = flat[k], 1e-2
        flat[k] = old + e
        a = loss()
        flat[k] = old - e
        b = loss()
        flat[k] = old
        assert abs((a - b) / (2 * e) - g[k]) < 0.05 * abs(g[k]) + 0.02, name


def test_lm_training_passes_over_places_that_only_give_context(monkeypatch):
    """Training takes scored places alone through the model; weights and counts are those of whole windows, step by step."""
    monkeypatch.setattr(attention_lm, "BATCH", 8)
    monkeypatch.setattr(attention_lm, "CHUNK", 6)
    skip = attention_lm.WINDOW - attention_lm.STRIDE
    draw = np.random.default_rng(6)
    common = draw.random(40)
    lengths = np.array([1, 3, 16, 17, 40, 300, 2000, 5000])
    ids = draw.integers(0, 40, lengths.sum())
    m, plain = (attention_lm.Model.drawn(common / common.sum(), 0) for _ in range(2))
    inputs, targets, scored = m.windows(ids, lengths)
    assert np.allclose(m.forward(inputs, skip)["mix"].reshape(len(inputs), attention_lm.STRIDE, -1), m.forward(inputs)["mix"].reshape(len(inputs), attention_lm.WINDOW, -1)[:, skip:], atol=1e-6)
    seen, forward = [], m.forward
    monkeypatch.setattr(m, "forward", lambda codes, begin=0: seen.append((len(codes), begin)) or forward(codes, begin))
    m.train(ids, lengths, 3)
    assert sum(n for n, _ in seen) == len(inputs) > 64 * 8
    assert sum(n * (attention_lm.WINDOW - begin) for n, begin in seen) < 0.8 * inputs.size
    order, weights = np.random.default_rng(3).permutation(len(inputs)), plain.weights
    first, second, fresh = np.zeros(len(weights)), np.zeros(len(weights)), 0
    for step, at in enumerate(range(0, len(order), 8), 1):
        rows = order[at : at + 8]
        f = plain.forward(inputs[rows])
        t, s = np.maximum(targets[rows].ravel(), 0), scored[rows].ravel()[:, None]
        joint = f["mix"] * plain.table[t]
        share = joint / joint.sum(axis=1, keepdims=True) * s
        slopes = {k: np.zeros(x, np.float32) for k, x in m.SHAPES.items()}
        plain._slopes(f, ((f["mix"] * s - share) / s.sum()).astype(np.float32), slopes)
        g = np.concatenate([x.ravel() for x in slopes.values()]).astype(float)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        weights -= (attention_lm.RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        each = np.zeros_like(plain.experts)
        np.add.at(each, t, share)
        fresh = fresh + each
        if step % 64 == 0:
            plain.experts, fresh = 0.7 * plain.experts + fresh, 0
            plain.refresh()
    plain.experts = plain.experts + fresh
    plain.refresh()
    assert np.allclose(m.experts, plain.experts, rtol=2e-2, atol=0.5)
    a, b = (x.log_probabilities(ids, lengths) for x in (m, plain))
    assert np.abs(a - b).max() < 0.02 and abs((a - b).sum()) < 1e-4 * abs(b.sum())


def test_lm_mixture_of_words_and_ids():
    got = attention_lm.mixed(np.array([-1.0, -2.0, -0.5]), np.array([2, 1]), np.array([0.1, 0.0]), np.array([0.3, 0.4]), np.array([1, 1]))
    assert np.allclose(got, [-1 + math.log10(0.1 + 0.3 * 1e-2), -0.5 + math.log10(0.4)])


def test_lm_learns_unseen_texts():
    import pyarrow.parquet as pq

    from siltstone.llm.word_tokens import WordTokens

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    ids = [np.frombuffer(b, "<u2").astype(np.int64) for b in WordTokens(path("word_bpe_49k.json"), 49407).encode([t.lower() for t in texts])]
    seen, new = ids[:800], ids[800:]
    common = np.bincount(np.concatenate(seen), minlength=49408) + 1.0
    m = attention_lm.Model.drawn(common / common.sum(), 49406)
    size = np.array([len(i) for i in new])
    before = m.log_probabilities(np.concatenate(new), size).sum()
    m.train(np.concatenate(seen), np.array([len(i) for i in seen]), 1)
    assert m.log_probabilities(np.concatenate(new), size).sum() > 0.95 * before
    assert m.log_probabilities(np.concatenate(new), size).sum() > 0.95 * np.log10(m.common[np.concatenate(new)]).sum()


def test_lm_every_training_document_takes_part(spark, edge_docs, edge_rows):
    got = [r.doc_id for turn in range(attention_lm.ROUNDS) for r in attention_lm.taking_part(edge_docs, turn).collect()]
    assert Counter(got) == Counter(i for i, _ in edge_rows if not attention_lm.is_held_out(i))
    rows = attention_lm.packed(edge_docs.selectExpr("abs(coalesce(doc_id, 0)) % 3 AS k", "doc_id", "cast(text AS binary) AS data"), "k").toArrow()
    assert Counter(zip(*attention_lm.unpacked(rows))) == Counter((i, t if t is None else t.encode()) for i, t in edge_rows)


def test_flat_ids():
    column = pa.array([b"\1\0", b"", b"\2\0\3\0", b"\4\0"], pa.binary())
    size, ids = attention_lm.flat_ids([column.slice(1, 2), column.slice(0, 0), column.slice(3), column.slice(1, 1)], 2)
    assert size.tolist() == [0, 2, 1, 0] and ids.tolist() == [2, 3, 4]
    assert [len(x) for x in attention_lm.flat_ids([], 2)] == [0, 0]
    assert attention_lm.flat_ids([column.cast(pa.large_binary())], 2)[1].tolist() == [1, 2, 3, 4]


def test_lm_scores_word_by_word(spark, edge_rows, monkeypatch):
    """Scores of untrained weights against plain loops over words, ids and places."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(attention_lm, "train_round", lambda docs, model, *_: model)
    rows = [r for r in edge_rows if len(r[1] or "") < 400]
    got = attention_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), path("word_bpe_49k.json")).collect()
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    lower = lambda t: (t or "").encode().lower().split()
    trained = [lower(t) for i, t in rows if not attention_lm.is_held_out(i)]
    count = Counter(w for ws in trained for w in ws)
    ids_of = {w: library.encode(w.decode(), add_special_tokens=False).ids for _, t in rows for w in lower(t)}
    total, found, seen, kinds = sum(count.values()) + len(trained), np.ones(library.get_vocab_size()), Counter(), Counter()
    found[49407] += len(trained)
    for w, n in count.items():
        for k, x in enumerate(ids_of[w]):
            found[x] += n
            if k == 0:
                seen[x] += n
                kinds[x] += 1
    m = attention_lm.Model.drawn(found / found.sum(), 49406)
    want = []
    for i, t in rows:
        flat, first, score = [x for w in lower(t) for x in ids_of[w]] + [49407], 0, 0.0
        p = []
        for at in range(len(flat)):
            w = max(0, -(-(at + 1 - attention_lm.WINDOW) // attention_lm.STRIDE)) * attention_lm.STRIDE
            before = [flat[k - 1] if k else 49406 for k in range(w, at + 1)]
            mix = m.forward(np.array([before + [0] * (attention_lm.WINDOW - len(before))]))["mix"][len(before) - 1]
            p.append(float(mix @ m.table[flat[at]]))
        for w in lower(t):
            own, n = ids_of[w], count[w]
            parts = p[first : first + len(own)]
            a, b = (seen[own[0]], kinds[own[0]]) if own else (total, 0)
            share, free = n / max(a + b, 1), b / max(a + b, 1) if a else 1.0
            score += math.log10((parts[0] if own else 1.0) * (share + (free * math.prod(parts[1:]) if own else 0.0)))
            first += len(own)
        want.append((str(i), score + math.log10(p[-1])))
    assert len(got) == len(want)
    for (i, a), (j, b) in zip(sorted((str(r.doc_id), r.score) for r in got), sorted(want)):
        assert i == j and abs(a - b) < 0.02 + 1e-4 * abs(b), (i, a, b)
