"""Operators against plain versions of themselves on small inputs."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from meltfield.llm import _words, op01_langid, op02_pii, op03_substring, op04_quality, op05_decontam, op06_tokens, op07_bpe, op08_simhash, op09_toxicity, op10_html
from meltfield.llm._batches import utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
V7, V6 = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def strings(n, seed, pool, length=40):
    r = random.Random(seed)
    return ["".join(r.choice(pool) for _ in range(r.randint(0, length))) for _ in range(n)]


PLAIN = [chr(c) for c in (*range(0x250), 0x3A3, 0x3C2, 0x660, 0x2028, 0x2160, 0x3000, 0x4E2D, 0x1F600, 0xFEFF, 0x130)] + [" "] * 80 + ["\n"] * 20 + ["'s", "'ll", "'", "the ", "ing"] * 10


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t) for i, t in zip(ids or range(len(texts)), texts)], "doc_id long, text string")


# ---- words -----------------------------------------------------------------------------------------------------------


def test_word_spans_and_hashes():
    texts = strings(400, 1, list("ab é\t\n\x0b\x1c\xa0"), 25) + [None, "x" * 3000]
    raw, offsets = utf8(pa.array(texts, pa.string()))
    for block in (7, 1 << 20):
        old, _words.BLOCK = _words.BLOCK, block
        try:
            starts, ends, rows = _words.spans(raw, offsets)
            h = _words.hashes(raw, starts, ends)
        finally:
            _words.BLOCK = old
        got = [[raw[starts[k] : ends[k]].tobytes().decode() for k in range(rows[i], rows[i + 1])] for i in range(len(texts))]
        assert got == [WORD.findall(t or "") for t in texts]
        seen = {}
        for w, v in zip((w for g in got for w in g), zip(h.tolist(), _words.other_hashes(raw, starts, ends).tolist())):
            assert seen.setdefault(w, v) == v
        assert all(len(set(x)) == len(seen) for x in zip(*seen.values()))


def test_second_hashes_differ_where_the_first_agree():
    """Two words of 2,048 letters in the Thue-Morse order have one polynomial hash modulo 2**64, whatever its constants."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    words = [a, b, a[:200], b[:200], a[:8], b[:8], "a" * 8, "a" * 9, "a\0", "a"]
    raw, offsets = utf8(pa.array([" ".join(words)]))
    starts, ends, _ = _words.spans(raw, offsets)
    assert len(set(_words.hashes(raw, starts, ends)[:2].tolist())) == 1 and len(set(_words.other_hashes(raw, starts, ends).tolist())) == len(words)


def test_windows():
    a = np.random.default_rng(0).integers(0, 3, 200).astype(np.uint64)
    for width in (1, 3, 8, 20):
        h, seen = _words.windows(a, width, 777), {}
        for i in range(200 - width + 1):
            assert seen.setdefault(tuple(a[i : i + width]), h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)


# ---- 1 language ------------------------------------------------------------------------------------------------------

SAMPLE = {"en": "the house and the garden with this that which thing", "de": "der hund und die katze nicht schön über straße", "ru": "это просто русский текст который мы читаем"}


def test_viterbi_is_optimal():
    r = np.random.default_rng(3)
    for _ in range(30):
        sizes = r.integers(0, 7, 4)
        rows = np.concatenate([[0], np.cumsum(sizes)])
        s = r.normal(0, 3, (rows[-1], 3)).astype(np.float32)
        label = op01_langid.viterbi(s, rows, 2.0)
        for a, b in zip(rows, rows[1:]):
            def value(path):
                return sum(s[a + i, p] for i, p in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))
            best = max((value(p) for p in np.ndindex(*[3] * (b - a))), default=0)
            assert value(label[a:b]) == pytest.approx(best, abs=1e-4)


def test_spans_of_mixed_text(spark):
    texts = [" ".join(SAMPLE[k].split() * 3) for k in SAMPLE]
    model = op01_langid.train(texts, list(SAMPLE))
    mixed = f"{SAMPLE['en']} {SAMPLE['en']}. {SAMPLE['de']} {SAMPLE['de']}! {SAMPLE['ru']}"
    rows = {r["doc_id"]: r for r in op01_langid.predict(frame(spark, [mixed, "123 ... !", None, SAMPLE["ru"], "Ωμέγα"]), model).collect()}
    spans = rows[0]["spans"]
    assert [s["lang"] for s in spans] == ["en", "de", "ru"] and mixed[spans[1]["start"] : spans[1]["end"]] == f"{SAMPLE['de']} {SAMPLE['de']}"
    assert rows[0]["lang_pred"] in ("en", "de") and 0 < rows[0]["score"] < 1
    assert [(rows[i]["lang_pred"], rows[i]["score"]) for i in (1, 2)] == [("und", 0.0)] * 2
    assert rows[3]["lang_pred"] == "ru" and rows[4]["lang_pred"] in SAMPLE
    assert op01_langid.predict(frame(spark, ["text"]), None).first()["lang_pred"] == "und"


def test_held_out_fold_and_its_use(spark):
    docs = frame(spark, [SAMPLE["en"], SAMPLE["de"]] * 40).selectExpr("doc_id", "text", "case when doc_id % 2 = 0 then 'en' else 'de' end as lang")
    model = op01_langid.fit(docs)
    poisoned = docs.selectExpr("doc_id", "text", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2 then 'xx' else lang end as lang")
    assert op01_langid.fit(poisoned)["langs"] == model["langs"] == ["de", "en"]
    got = op01_langid.digest(op01_langid.predict(docs, model)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 == 0 else "de") for r in got)


# ---- 2 personal data -------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_pattern(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) * 2 for c in digits[-2::-2]]
            luhn = (sum(map(int, digits[-1::-2])) + sum(d // 10 + d % 10 for d in double)) % 10 == 0
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn, "phone": lambda: 8 <= len(digits) <= 15}[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_patterns():
    r = random.Random(3)
    parts = ["4111111111111111", "4111 1111 1111 1111", "+1 (555)", "a@b.c", "1.2.3.4", ".", "255", "256", "0001", " ", "-", "@", "x", "+"]
    texts = strings(15000, 4, list("0123456789019..@@+ -()ab\n"), 60) + ["".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(8000)]
    for t in texts:
        assert op02_pii.base_spans(t) == base_by_pattern(t), t


def test_digest_and_added_spans(spark):
    texts = [f"mail a{i}@x.example.com and +1 (555) 555-{i:04d} or 10.0.0.{i}, total {i}.5 for {i} items" for i in range(60)]
    hidden = "pay 4111111111111111 today. call 55 4111111111111111 again"  # the second run of digits is too long for a card
    model = op02_pii.train(texts + ["card 4111111111111111 here"] * 20)
    docs = frame(spark, [hidden, texts[0], None])
    rows = {r["doc_id"]: r for r in op02_pii.digest(op02_pii.detect(docs, model)).collect()}
    base = base_by_pattern(hidden)
    assert rows[0]["n_card"] == len(base) == 1 and rows[0]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert rows[0]["spans"].startswith("card:4:20") and f"card:{hidden.rindex('4111')}:{hidden.rindex('4111') + 16}" in rows[0]["spans"]
    assert (rows[1]["n_email"], rows[1]["n_phone"], rows[1]["n_ip"]) == (1, 1, 1) and rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    red = {r["doc_id"]: r for r in op02_pii.redact(docs.selectExpr("doc_id", "text", "length(text) as n_chars"), model).collect()}
    assert "a0@x" not in red[1]["text"] and "[EMAIL]" in red[1]["text"] and red[1]["n_chars"] == len(red[1]["text"]) and red[2]["text"] is None


def enumerated(unary, edges, psi):
    n, k = unary.shape
    out = np.zeros((n, k))
    for x in np.ndindex(*[k] * n):
        w = np.exp(sum(unary[i, x[i]] for i in range(n)) + sum(psi[e, x[i], x[j]] for i, j, e in edges))
        for i in range(n):
            out[i, x[i]] += w
    return out / out.sum(1, keepdims=True)


def test_loopy_messages_agree_with_enumeration():
    r = np.random.default_rng(0)
    for _ in range(20):
        unary, psi = r.normal(size=(5, 3)), r.normal(size=(3, 3, 3))
        tree = np.array([[0, 1, 2], [1, 2, 0], [3, 1, 2], [3, 4, 1]])
        assert np.allclose(op02_pii.marginals(unary, tree, psi), enumerated(unary, tree, psi), atol=1e-3)
        loops = np.array([[0, 1, 0], [1, 2, 1], [0, 2, 2], [2, 3, 0], [3, 4, 1], [4, 2, 1]])
        assert np.abs(op02_pii.marginals(unary, loops, psi / 2) - enumerated(unary, loops, psi / 2)).max() < 0.08
    assert np.allclose(op02_pii.marginals(unary, np.zeros((0, 3), np.int64), psi), np.exp(unary) / np.exp(unary).sum(1, keepdims=True))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [last := i + 1] + [last := min(row[j + 1] + 1, last + 1, row[j] + (x != y)) for j, y in enumerate(b)]
    return row[-1]


def test_similar_values():
    r = random.Random(5)
    for _ in range(4000):
        a = "".join(r.choice("ab1") for _ in range(r.randint(6, 11)))
        b = list(a)
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(b))
            b[i : i + r.randint(0, 1)] = r.choice(["", "a", "1"])
        b = "".join(b)
        short, long = sorted((a, b), key=len)
        digits = a.isdigit() and b.isdigit() and short[-7:] == long[-7:] and len(short) >= 7
        close = len(short) >= 8 and (edits(a, b) <= 1 or long.startswith(short) or long.endswith(short))
        if not (a.isdigit() or b.isdigit()):
            assert op02_pii.similar(a, b) == op02_pii.similar(b, a) == (close or digits), (a, b)


@pytest.fixture(scope="module")
def field():
    r = random.Random(9)
    def digits(n):
        return "".join(r.choice("0123456789") for _ in range(n))
    def card():
        d = digits(15)
        return next(d + c for c in "0123456789" if op02_pii.luhn(d + c))
    texts = []
    for i in range(300):
        texts.append(r.choice([f"mail {r.choice('abcdefgh')}{digits(3)}.name@host{i}.example.com now", f"card {card()} ok", f"phone +{digits(11)} day", f"from 10.{i % 250}.0.{i % 99}", f"order {digits(8)} of 2024, {i} items", f"id {digits(12)} and {digits(10)}"]))
    return op02_pii.train(texts)


@pytest.mark.parametrize(
    "text, found",
    [
        ("Call +1 555 010 4477 now. Later 555 010 4477, or 1-555-010-4477 again.", [("phone", "555 010 4477"), ("phone", "1-555-010-4477")]),
        ("mail bob.smith@example.com, then bob.smith@example and bob.smith.example.com", [("email", "bob.smith@example"), ("email", "bob.smith.example.com")]),
        ("pay 4111111111111111 or, if it fails, 411111111111111 and 4111111111111112.", [("card", "411111111111111"), ("card", "4111111111111112")]),
        ("hosts 10.20.30.41 and 10.20.30.410 fail", [("ip", "10.20.30.410")]),
        ("order 5550104477 shipped, 4111111111111112 items in 2024, part 12345678", []),
        ("mail ann@example.com about order 5550104477 and part 2345678, see section 3.1.4", []),
    ],
)
def test_broken_repeats_are_found_and_others_are_not(text, found, field):
    base, more = op02_pii.all_spans(text, field)
    assert base == base_by_pattern(text) and [(k, text[a:b]) for k, a, b in sorted(more, key=lambda s: s[1])] == found


def test_evidence_reaches_every_copy(field):
    text = "+1 555 010 4477 is the number. " + "More words about something else. 555 010 4477 here. " * 60
    base, more = op02_pii.all_spans(text, field)
    assert len(base) == 1 and len(more) == 60 and {text[a:b] for _, a, b in more} == {"555 010 4477"}


def test_every_two_similar_values_are_linked():
    r = random.Random(11)
    for signs, size in (("12", 9), ("0123456789", 8), ("ab@.", 10), ("a1", 8), ("é\U0001f600@", 9)):
        for _ in range(12):
            front = "".join(r.choice(signs) for _ in range(5))
            values = ["".join(r.choice(signs) for _ in range(r.randint(6, size))) for _ in range(60)]
            values += [front + "".join(r.choice(signs) for _ in range(r.randint(1, 4))) for _ in range(40)]
            values += [v[: r.randrange(len(v))] + r.choice(signs) + v[r.randrange(len(v)) :] for v in values]
            values = list(dict.fromkeys(values))
            pairs, groups = op02_pii.partners(values)
            linked = pairs + [(min(p), max(p)) for g in groups for p in itertools.combinations(g, 2)]
            assert len(linked) == len(set(linked))
            assert set(linked) == {(a, b) for a, b in itertools.combinations(range(len(values)), 2) if op02_pii.similar(values[a], values[b])}
    started = time.perf_counter()  # nested, repetitive and many values of one end cost linear time
    pairs, groups = op02_pii.partners(["a" * 200_000, "a" * 199_999, "a" * 199_998 + "b"] + [f"user{i}@example.com" for i in range(30_000)] + [f"{i}5550104477" for i in range(30_000)])
    assert (0, 1) in pairs and (1, 2) in pairs and max(map(len, groups)) == 30_000 and time.perf_counter() - started < 60


def test_two_edges_of_a_group_weigh_as_one(field):
    unary = np.array([[0.0, 3, 0, 0, 0], [2, 0, 0, 0, 0], [0] * 5])
    direct = op02_pii.marginals(unary, np.array([[0, 1, op02_pii.SIMILAR]]), field["psi"])
    assert np.allclose(op02_pii.marginals(unary, np.array([[0, 2, op02_pii.GROUP], [1, 2, op02_pii.GROUP]]), field["psi"])[:2], direct[:2], atol=1e-3)


@pytest.mark.parametrize(
    "text, found",
    [
        ("mail bob.smith@example.com or bob.brown@sample.com, then bob.smith.example.com again", ["bob.smith.example.com"]),
        ("hosts 10.20.30.41, 10.20.99.41 and 10.20.77.66 up, 10.20.30.410 down", ["10.20.30.410"]),
    ],
)
def test_evidence_comes_from_earlier_values_too(text, found, field):
    base, more = op02_pii.all_spans(text, field)
    assert base == base_by_pattern(text) and [text[a:b] for _, a, b in more] == found


def test_redaction_reaches_partners_of_earlier_values(spark, field):
    text = "mail bob.smith@example.com or bob.brown@sample.com, then bob.smith.example.com again"
    red = op02_pii.redact(frame(spark, [text]), field).collect()
    assert red[0]["text"] == "mail [EMAIL] or [EMAIL], then [EMAIL] again"
    for a, b in (("1234567", "1@34567"), ("1234567", "12345678"), ("1234567", "1@345678")):
        assert op02_pii.similar(a, b) == op02_pii.similar(b, a) == (b == "12345678")


@pytest.mark.parametrize(
    "text, redacted",
    [
        ("Call +1 555 010 4477 now. Later 15550104477 15550104477 again.", "Call [PHONE] now. Later [PHONE] [PHONE] again."),
        ("Call +1 555 010 4477 now. Later 15550104477 5550104477 again.", "Call [PHONE] now. Later [PHONE] [PHONE] again."),
        ("pay 4111111111111111 or 4111111111111111 4111111111111111-4111111111111111 now", "pay [CARD] or [CARD] [CARD]-[CARD] now"),
        ("pay 4111111111111111 or +1 555 010 4477 then 4111111111111111 15550104477 end", "pay [CARD] or [PHONE] then [CARD] [PHONE] end"),
        ("pay 4111111111111111 or, if it fails, 5424180123456789 4111111111111111 now", "pay [CARD] or, if it fails, 5424180123456789 [CARD] now"),
    ],
)
def test_every_value_in_a_run_is_found(spark, text, redacted, field):
    assert op02_pii.redact(frame(spark, [text]), field).collect()[0]["text"] == redacted


def test_runs_are_cut_at_every_known_value():
    r = random.Random(3)
    for _ in range(3000):
        known = list(dict.fromkeys("".join(r.choice("12") for _ in range(r.randint(7, 10))) for _ in range(r.randint(1, 4))))
        base, text = [], ""
        for v in known:
            base.append(("phone", len(text), len(text) + len(v)))
            text += v + " ; "
        run = "".join(r.choice([*known, "1", "2", "12"]) for _ in range(r.randint(1, 8)))
        got = [t for _, _, t in op02_pii.nodes(text + run, base)][len(known) :]
        want, rest, i = [], "", 0
        while i < len(run):
            hit = max((v for v in known if run.startswith(v, i)), key=len, default="")
            want, rest = (want + [rest, hit], "") if hit else (want, rest + run[i])
            i += len(hit) or 1
        want.append(rest)
        assert got == ([run] if run in known else [w for w in want if len(w) >= 7])
    started = time.perf_counter()  # many known values of one front cost linear time
    known = [f"1555010{i:05d}" for i in range(30_000, 50_000)]
    base = [("phone", 13 * k, 13 * k + 12) for k in range(len(known))]
    found = op02_pii.nodes(";".join(known) + ";" + "1555010" * 20_000 + "".join(known), base)
    assert len(found) == 2 * len(known) + 1 and time.perf_counter() - started < 30


def test_messages_settle_however_far_evidence_goes(field):
    """A ladder of similar values, a hundred times as long as the passes over all messages: the same as with passes for all."""
    psi, n = np.log(np.full((4, 5, 5), 0.05) + np.eye(5)), 100 * op02_pii.PASSES
    edges = np.array([(2 * i, 2 * i + 1, op02_pii.SIMILAR) for i in range(n)] + [(2 * i + a, 2 * i + 2 + a, op02_pii.SIMILAR) for i in range(n - 1) for a in (0, 1)])
    unary = np.zeros((2 * n, 5))
    unary[0] = [-60, -60, -60, -60, 0]
    assert op02_pii.marginals(unary, edges, psi)[:, 4].min() > 0.9
    swings = np.log(np.full((4, 5, 5), 1.0) - 0.999 * np.eye(5))  # nothing settles where neighbours must differ
    r = np.random.default_rng(4)
    p = op02_pii.marginals(r.normal(size=(40, 5)), np.array([(a, b, op02_pii.SIMILAR) for a in range(40) for b in range(a)]), swings)
    assert np.isfinite(p).all() and np.allclose(p.sum(1), 1)


# ---- 3 repeated passages ---------------------------------------------------------------------------------------------


def test_difference_cover():
    for d in range(op03_substring.PERIOD):
        assert any((a - b) % op03_substring.PERIOD == d for a in op03_substring.COVER for b in op03_substring.COVER)


def dedup_by_dictionary(texts):
    seen, out = set(), []
    for t in texts:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_dedup_matches_a_dictionary(spark, seed, monkeypatch):
    monkeypatch.setattr(op03_substring, "COMBINE", 300)
    monkeypatch.setattr(op03_substring, "KNOWN", 50)
    r = random.Random(seed)
    passages = [[f"w{r.randint(0, 400)}" for _ in range(r.choice([19, 20, 21, 33, 60]))] for _ in range(8)]
    texts = []
    for _ in range(120):
        words = []
        for _ in range(r.randint(0, 5)):
            words += r.choice(passages) if r.random() < 0.6 else [f"v{r.randint(0, 5000)}" for _ in range(r.randint(0, 40))]
        texts.append(r.choice([" ", "\n", " \t"]).join(words))
    texts += [" ".join(["a"] * 70), " ".join(["a"] * 25), None, ""] + texts[:6]
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in op03_substring.dedup(frame(spark, texts).repartition(5)).collect()}
    assert [got[i] for i in range(len(texts))] == dedup_by_dictionary(texts)


@pytest.mark.parametrize("key", [None, 7])
def test_dedup_of_many_rows_under_one_id(spark, key):
    """2,000 rows without an id (or with one id): a dictionary in the order of the texts' hashes."""
    r = random.Random(11)
    shared = [" ".join(f"s{j}w{i}" for i in range(25)) for j in range(3)]
    texts = [" ".join(f"v{r.randint(0, 10**6)}" for _ in range(r.randint(0, 30))) + (" " + r.choice(shared) if r.random() < 0.4 else "") for _ in range(2000)]
    docs = spark.createDataFrame([(key, t) for t in texts], "doc_id long, text string")
    order = [x["text"] for x in docs.selectExpr("text", "xxhash64(text) as h").orderBy("h").collect()]
    want = collections.Counter(dedup_by_dictionary(order))
    assert collections.Counter((x["n_words"], x["n_removed"], x["kept"]) for x in op03_substring.dedup(docs.repartition(6)).collect()) == want


def test_dedup_with_repeated_ids(spark):
    p = " ".join(f"w{i}" for i in range(30))
    docs = frame(spark, [p, p, "x " + p, p], [1, 1, 1, 2])
    rows = op03_substring.dedup(docs).collect()
    assert sum(r["n_removed"] == 0 for r in rows) in (1, 2) and [r["n_removed"] for r in rows if r["doc_id"] == 2] == [30]
    same = [r["n_removed"] for r in rows if r["doc_id"] == 1 and r["n_words"] == 30]
    assert same[0] == same[1]


# ---- 4 quality -------------------------------------------------------------------------------------------------------


def test_statistics_match():
    texts = strings(400, 7, ["a ", "b ", "c ", "a b c ", "\n", "# ", "é|", "x\n", "\t", "\x1c"], 60) + [None, ""]
    s = op04_quality.statistics(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        t = t or ""
        w, seen, dup, mark = WORD.findall(t), set(), 0, set()
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        for j in range(len(w) - 2):
            if c[tuple(w[j : j + 3])] > 1:
                mark |= {j, j + 1, j + 2}
        assert tuple(int(s[b][i]) for b in op04_quality.BASE) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(mark)), t


def test_trees_are_monotonic_and_learn():
    r = np.random.default_rng(0)
    x = r.random((1500, len(op04_quality.FEATURES)))
    y = ((x[:, 2] < 0.4) | (x[:, 0] > 0.8)).astype(float)
    y = np.where(r.random(1500) < 0.05, 1 - y, y)
    model = op04_quality.grow(x, y)
    assert ((op04_quality.score(model, x) > 0.5) == y).mean() > 0.93
    for f, direction in enumerate(op04_quality.FEATURES.values()):
        if direction:
            probe = np.repeat(x[:40], 30, axis=0)
            probe[:, f] = np.tile(np.linspace(-1, 2, 30), 40)
            steps = np.diff(op04_quality.score(model, probe).reshape(40, 30), axis=1)
            assert (direction * steps >= -1e-12).all()

    def one(row, t, node=0):
        if 2 * node + 2 >= model["feature"].shape[1]:
            return model["value"][t, node]
        return one(row, t, 2 * node + 1 + int(row[model["feature"][t, node]] > model["threshold"][t, node]))

    expected = [1 / (1 + np.exp(-(model["start"] + sum(one(row, t) for t in range(op04_quality.TREES))))) for row in x[:20]]
    assert np.allclose(op04_quality.score(model, x[:20]), expected)
    assert op04_quality.grow(x, np.ones(1500)) is None


# ---- 5 decontamination -----------------------------------------------------------------------------------------------


def test_containment_matches_sets(spark):
    r = random.Random(2)
    items = [" ".join(f"b{r.randint(0, 60)}" for _ in range(r.choice([3, 5, 9, 30, 64]))) for _ in range(30)]
    texts = []
    for _ in range(60):
        w = [f"d{r.randint(0, 300)}" for _ in range(r.randint(0, 200))]
        for item in r.sample(items, 2):
            part = item.upper().split()
            for _ in range(r.choice([0, 0, 1, 2])):
                part[r.randrange(len(part))] = "zz"
            at = r.randint(0, len(w))
            w[at:at] = part
        texts.append(r.choice([" ", ", ", "\n"]).join(w))
    def shingles(t, n=5):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    expected = set()
    for i, t in enumerate(texts):
        for j, b in enumerate(items):
            n = min(5, len(b.split()))
            q = shingles(b, n)
            if len(q & shingles(t, n)) >= 0.8 * len(q):
                expected.add((i, j))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert len(expected) > 20
    assert {(x["doc_id"], x["item_id"]) for x in op05_decontam.contaminated(frame(spark, texts), bench).collect()} == expected


# ---- 6 token files ---------------------------------------------------------------------------------------------------


def test_token_ids_match_the_library():
    library, e = Tokenizer.from_file(V6), op06_tokens.Encoder(V6)
    texts = strings(6000, 5, PLAIN) + ["a<|endoftext|>b", "", "'", "x's", "'re'", " 's", "\n 'd", "  ", "a  b"]
    got = [x for i in range(0, len(texts), 500) for x in e.encode(texts[i : i + 500])]
    for t, ids in zip(texts, got):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_known_pretokens_are_kept_in_arrays_and_forgotten(monkeypatch):
    """Whole batches are looked up at once; what was met last stays, however often pre-tokens are forgotten."""
    library, e = Tokenizer.from_file(V6), op06_tokens.Encoder(V6)
    monkeypatch.setattr(op06_tokens, "CACHE_WORDS", 300)
    r, forgotten = random.Random(8), 0
    for n in range(60):
        texts = strings(30, 100 + n, PLAIN) + [" always here", "x" * 200, " ".join("".join(r.choice("abcé") for _ in range(4)) for _ in range(40)), ""]
        before = len(e.words)
        for t, ids in zip(texts, e.encode(texts)):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
        forgotten += len(e.words) < before
        assert len(set(e.words.to_pylist())) == len(e.words) == len(e.first) == len(e.length) == len(e.met) and e.length.sum() == len(e.flat)
        assert b" always" in e.words.to_pylist()
    assert forgotten > 5


def test_common_pretokens_are_given_to_the_library_once(monkeypatch):
    """Those met in many calls stay, though a call brings more new ones than are kept."""
    library, e = Tokenizer.from_file(V6), op06_tokens.Encoder(V6)
    monkeypatch.setattr(op06_tokens, "CACHE_WORDS", 300)
    asked, ask = [], e._ask
    monkeypatch.setattr(e, "_ask", lambda words: asked.extend(words) or ask(words))
    common, r = "".join(f" common{chr(97 + i)}é" for i in range(26)), random.Random(4)
    for _ in range(12):
        for text in (common, common, "".join(f" {''.join(r.choice('abcdefghij') for _ in range(9))}" for _ in range(400))):
            assert e.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted(w for w in asked if w.startswith(b" common")) == sorted(f" common{chr(97 + i)}é".encode() for i in range(26))


def test_pretokens_of_one_hash_are_told_apart(monkeypatch):
    library, texts = Tokenizer.from_file(V6), strings(50, 77, PLAIN) + ["unequal words, unequaX words", "x" * 300 + " " + "x" * 299 + "y", "\0 a\0 a"]
    own = op06_tokens.word_keys
    for keys in (own, lambda *x: np.where(x[2] > op06_tokens.SURE, np.uint64(7), own(*x)), lambda *x: own(*x) >> np.uint64(62) * (x[2] > op06_tokens.SURE)):
        monkeypatch.setattr(op06_tokens, "word_keys", keys)
        e = op06_tokens.Encoder(V6)
        for _ in range(2):
            for t, ids in zip(texts, e.encode(texts)):
                assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
    every = [bytes(x) for n in (1, 2) for x in itertools.product(range(0, 256, 5), repeat=n)] + [b"\0" * n for n in range(3, 8)]
    size = np.fromiter(map(len, every), np.int64)
    monkeypatch.undo()
    assert len(np.unique(op06_tokens.word_keys(b"".join(every), np.cumsum(size) - size, size))) == len(every)


def test_pretokens_of_blocks_of_texts(monkeypatch):
    library, texts = Tokenizer.from_file(V6), strings(400, 31, PLAIN) + ["", "", "é" * 40, "", "a b"]
    for split, words in ((1, 1), (7, 3), (50, 1000)):
        monkeypatch.setattr(op06_tokens, "SPLIT", split)
        monkeypatch.setattr(op06_tokens, "SPLIT_WORDS", words)
        for t, ids in zip(texts, op06_tokens.Encoder(V6).encode(texts)):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_pieces_are_gathered_whole(monkeypatch):
    monkeypatch.setattr(op06_tokens, "PIECE", 10)
    texts = ["abc", None, "", "defghij", "k", "l" * 40, "m", "é" * 9, "no"]
    pieces = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": pa.array([t], pa.string())}) for i, t in enumerate(texts)]
    got = list(op06_tokens._gathered(iter(pieces)))
    assert [(k, "".join(t)) for k, t in got] == [([0, 1, 2, 3], "abcdefghij"), ([4], "k"), ([5], "l" * 40), ([6, 7], "m" + "é" * 9), ([8], "no")]


def test_coder_round_trip():
    r = np.random.default_rng(1)
    cases = [r.integers(0, op06_tokens.MAX_ID + 1, 400), np.zeros(20_000, np.int64), r.integers(0, 5, 9000), np.full(1, op06_tokens.MAX_ID), r.zipf(1.3, 30_000) % 50_000, np.tile(r.integers(0, 999, 700), 12), np.arange(70_000) % 69_000]
    for n in (0, 1, 3, 7):
        frames = [c.astype(np.int32) for c in cases[:n]]
        payloads = op06_tokens.encode_frames(frames)
        back = op06_tokens.decode_frames(payloads)
        assert len(back) == n and all(np.array_equal(a, b) for a, b in zip(frames, back))
        for p, f in zip(payloads, frames):  # each frame by itself
            assert np.array_equal(op06_tokens.decode_frames([p])[0], f)
    assert len(payloads[1]) < 1000 and len(payloads[5]) < 2 * 8400 * 0.4  # one id; a repeated passage
    n, table, coded, sums = op06_tokens.unpack(payloads[4])  # each block by itself
    for k, c in enumerate(coded):
        want = frames[4][k * op06_tokens.BLOCK : (k + 1) * op06_tokens.BLOCK]
        assert np.array_equal(table.ids[op06_tokens.decode_blocks([c], np.array([len(want)]), np.zeros(1, np.int64), [table])], want)
    with pytest.raises(ValueError):
        op06_tokens.encode_frames([np.array([op06_tokens.MAX_ID + 1])])


def test_shares_stay_a_distribution():
    """Any outcomes: every place keeps its least share, and the mixed bounds rise from 0 to the whole."""
    r, m = np.random.default_rng(2), 64
    model = op06_tokens._Model(m)
    for t in range(3000):
        model.predict(m)
        place = model.place_of(x := r.integers(0, 12 if t % 2 else 40, m).astype(np.int32))
        low, share = zip(*(model.bounds(np.full(m, k)) for k in range(op06_tokens.WAYS + 1)))
        low, share = np.array(low), np.array(share)
        assert (low[0] == 0).all() and (share >= 1).all() and (low[1:] == (low + share)[:-1]).all() and (low[-1] + share[-1] == op06_tokens.ONE).all()
        value = r.integers(0, op06_tokens.ONE, m).astype(np.int32)
        assert np.array_equal(model.outcome(value), (low <= value).sum(0) - 1)
        model.update(m, x, place)


def test_damage_is_found():
    ids = np.random.default_rng(0).integers(0, 50257, 15_000).astype(np.int32)
    payload = op06_tokens.encode_frames([ids])[0]
    assert np.array_equal(op06_tokens.decode_frames([payload])[0], ids)
    for at in (0, 5, 13, 30, len(payload) // 2, len(payload) - 40):
        bad = bytearray(payload)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            op06_tokens.decode_frames([bytes(bad)])
    with pytest.raises(ValueError):
        op06_tokens.decode_frames([payload[:-1]])


@pytest.mark.skipif(not Path(SF).is_dir(), reason="test tables are not here")
def test_files_are_smaller_than_order_0_and_deflate(spark):
    texts = [t.text or "" for t in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect()]
    ids = np.concatenate([x for e in op06_tokens.Encoder(V6).encode(texts) for x in (e, [0])]).astype(np.int32)
    bits = 8 * len(op06_tokens.encode_frames([ids])[0]) / len(ids)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    deflated = 8 * sum(len(zlib.compress(ids[k : k + op06_tokens.BLOCK].astype("<u2").tobytes())) for k in range(0, len(ids), op06_tokens.BLOCK)) / len(ids)
    assert bits < -(share * np.log2(share)).sum() and bits < deflated - 1


def test_characters_are_classed_as_in_the_library():
    """Every assigned character, and some that Python does not know, between letters, digits and quotes."""
    every = [chr(x) for x in (*range(0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xE1000), *range(0x40000, 0x40020), *range(0xF0000, 0xF0020))]
    random.Random(1).shuffle(every)
    texts = [f"a{every[i]}{every[i - 1]}b 1'{every[i]}s {every[i]} x" for i in range(0, len(every), 4)]
    library, e = Tokenizer.from_file(V6), op06_tokens.Encoder(V6)
    for t, want, ids in zip(texts, library.encode_batch(texts, add_special_tokens=False), e.encode(texts)):
        assert ids.tolist() == want.ids, t
    library, codec = Tokenizer.from_file(V7), op07_bpe.codec(V7)
    for t, want, ids in zip(texts, library.encode_batch(texts, add_special_tokens=False), codec.batch(texts)[1].to_pylist()):
        assert np.frombuffer(codec.encode_bytes(t), "<u4").tolist() == np.frombuffer(ids, "<u4").tolist() == want.ids, t


def test_files_keep_order_and_places(spark, monkeypatch):
    texts = strings(80, 9, PLAIN, 200) + [None, ""]
    ids = random.Random(1).sample(range(1000), len(texts))
    rows = op06_tokens.digest(op06_tokens.read(op06_tokens.write(frame(spark, texts, ids).repartition(3), V6))).collect()
    got, at, library = {r["doc_id"]: r for r in rows}, 0, Tokenizer.from_file(V6)
    for i, t in sorted(zip(ids, texts)):
        own = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_documents_of_frames_leave_one_frame_at_a_time():
    r = np.random.default_rng(3)
    frames = [r.integers(0, 500, n).astype(np.int32) for n in (9000, 5000, 1)]
    payloads = op06_tokens.encode_frames(frames)
    rows = [{"part": 2, "start": b, "docs": [{"doc_id": 10 * k + j, "n_tokens": n} for j, n in enumerate(split)], "payload": p, "n_tokens": len(f)} for k, (b, f, p, split) in enumerate(zip((0, 9000, 14000), frames, payloads, ((4000, 1, 4999), (5000,), (1,))))]
    op06_tokens.encoder(V6)
    out = list(op06_tokens.documents_of([pa.RecordBatch.from_pylist(rows[:2]), pa.RecordBatch.from_pylist(rows[2:])], {2: 100}))
    assert not op06_tokens._ENCODERS and [b.num_rows for b in out] == [3, 1, 1]
    got = [d for b in out for d in b.to_pylist()]
    assert [(d["doc_id"], d["start"], d["n_tokens"]) for d in got] == [(0, 100, 4000), (1, 4100, 1), (2, 4101, 4999), (10, 9100, 5000), (20, 14100, 1)]
    assert b"".join(d["ids"] for d in got) == np.concatenate(frames).astype("<u4").tobytes()


def test_the_last_frames_are_decoded_with_those_before(monkeypatch):
    """Frames leave in order, all of them, and a rest of less than half a group is no group of its own."""
    calls, decode = [], op06_tokens.decode_frames
    monkeypatch.setattr(op06_tokens, "TOGETHER", 1000)
    monkeypatch.setattr(op06_tokens, "decode_frames", lambda payloads: calls.append(len(payloads)) or decode(payloads))
    for sizes, want in (([100] * 13, [13]), ([100] * 14, [14]), ([100] * 15, [10, 5]), ([100] * 27, [10, 10, 7]), ([100, 5000, 100, 3000, 100], [2, 2, 1]), ([9], [1]), ([], [])):
        frames = [np.random.default_rng(n).integers(0, 50, n).astype(np.int32) for n in sizes]
        rows = [{"part": 0, "start": 0, "docs": [{"doc_id": k, "n_tokens": len(f)}], "payload": p, "n_tokens": len(f)} for k, (f, p) in enumerate(zip(frames, op06_tokens.encode_frames(frames)))]
        calls.clear()
        got = [d for b in op06_tokens.documents_of([pa.RecordBatch.from_pylist([r]) for r in rows], {0: 0}) for d in b.to_pylist()]
        assert calls == want and [d["doc_id"] for d in got] == list(range(len(frames)))
        assert [d["ids"] for d in got] == [f.astype("<u4").tobytes() for f in frames]


def test_writing_leaves_the_session_as_it_was(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = [f"text {i}" for i in range(2500)]
    got = op06_tokens.read(op06_tokens.write(frame(spark, texts), V6)).orderBy("doc_id").collect()
    library = Tokenizer.from_file(V6)
    assert [np.frombuffer(g["ids"], "<u4").tolist() for g in got] == [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


# ---- 7 BPE -----------------------------------------------------------------------------------------------------------


def test_bpe_matches_the_library(spark):
    library, codec = Tokenizer.from_file(V7), op07_bpe.codec(V7)
    texts = strings(6000, 6, PLAIN) + ["ΣΑΣ İstanbul", "a<|endoftext|>B<|startoftext|>", "x" * 400, "aaaaabaaaab" * 30]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        own = np.frombuffer(codec.encode_bytes(t), "<u4").tolist()
        assert own == ids and codec.decode(own) == library.decode(ids, skip_special_tokens=False), t
    texts += ["'s", "a'", "'", "x''s 're'll'd", "12'34", "", "\"'s", "'sam 'veve 'l 'r", "’s"]
    for at in range(0, len(texts), 700):  # many texts together
        part = texts[at : at + 700]
        n, ids, decoded = codec.batch(part)
        for t, k, i, d in zip(part, n.tolist(), ids.to_pylist(), decoded.to_pylist()):
            want = library.encode(t, add_special_tokens=False).ids
            assert (k, np.frombuffer(i, "<u4").tolist(), d) == (len(want), want, library.decode(want, skip_special_tokens=False)), t
    encoded = op07_bpe.encode(frame(spark, texts[:50]), V7)
    back = {r["doc_id"]: r["decoded"] for r in op07_bpe.decode(encoded, V7).collect()}
    assert all(back[r["doc_id"]] == r["decoded"] for r in encoded.collect())
    r = {x["doc_id"]: x for x in op07_bpe.digest(encoded).collect()}[7]
    ids = library.encode(texts[7], add_special_tokens=False).ids
    assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


# ---- 8 SimHash -------------------------------------------------------------------------------------------------------


def simple_fingerprint(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components_by_pairs(fps):
    root = list(range(len(fps)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components(spark):
    r = random.Random(8)
    base = [" ".join(f"w{r.randint(0, 900)}" for _ in range(r.choice([1, 2, 3, 60, 400]))) for _ in range(40)]
    texts = [*base, *base[:10], None, "", " "]
    for t in base[:20]:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w).title())
    fps = [simple_fingerprint(t) for t in texts]
    got = {x["doc_id"]: x for x in op08_simhash.digest(op08_simhash.near_duplicates(frame(spark, texts).repartition(4))).collect()}
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == components_by_pairs(fps)


@pytest.mark.parametrize("key", range(6))
def test_key_links_span_all_links_under_a_key(key):
    r = random.Random(key)
    members = {r.getrandbits(64) for _ in range(20)}
    for m in list(members):
        for _ in range(4):
            members.add(m ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    members |= {(m := r.getrandbits(64)) ^ (x << 16) for x in r.sample(range(65536), 1500)}  # long runs: bytes 2 and 3 are free
    fps = sorted(members)
    mask = sum(0xFFFF << (16 * p) for p in op08_simhash.KEYS[key])
    a, b = op08_simhash.key_links(np.array(fps, np.uint64), key)
    x = np.array(fps, np.uint64)
    near = [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero((np.bitwise_count(x ^ x[i]) <= 2) & ((x ^ x[i]) & np.uint64(mask) == 0)) if i < j]
    place = {f: i for i, f in enumerate(fps)}
    def roots(edges):
        root = list(range(len(fps)))
        def find(i):
            while root[i] != i:
                i = root[i]
            return i
        for i, j in edges:
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
        return [find(i) for i in range(len(fps))]
    assert near and roots(near) == roots([(place[i], place[j]) for i, j in zip(a.tolist(), b.tolist())])


def test_links_over_all_keys(spark):
    r = random.Random(1)
    fps = {r.getrandbits(64) for _ in range(150)}
    for f in list(fps):
        fps.add(f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)]
    edges = {(x["a"] & (1 << 64) - 1, x["b"] & (1 << 64) - 1) for x in op08_simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    near = {frozenset((a, b)) for a in fps for b in fps if a != b and bin(a ^ b).count("1") <= 2}
    assert {frozenset(e) for e in edges} <= near and near and {x for e in near for x in e} == {x for e in edges for x in e}


# ---- 9 toxicity ------------------------------------------------------------------------------------------------------


def test_severity_grows_and_separates(spark):
    r = random.Random(3)
    clean = [" ".join(f"word{r.randint(0, 300)}" for _ in range(60)) for _ in range(300)]
    bad = ["grobian", "schurke", "lump"]
    toxic = []
    for i in range(90):
        w = clean[i].split()
        for _ in range(1 + i % 6):
            w[r.randrange(len(w))] = r.choice(bad)
        toxic.append(" ".join(w))
    model = op09_toxicity.train(clean[:250] + toxic[:60], [0] * 250 + [1] * 60)
    assert (np.diff(model["thresholds"]) > 0).all() and (model["weights"] >= 0).all()
    up = op09_toxicity.severity(model, pa.array(clean[250:] + toxic[60:] + [None, ""]))
    assert (up[:50, 0] < 0.5).all() and (up[50:80, 0] >= 0.5).mean() >= 0.9 and (np.diff(up, axis=1) <= 0).all()
    more = op09_toxicity.severity(model, pa.array([" ".join(["word1"] * 30 + bad * k) for k in range(5)])).sum(1)
    assert (np.diff(more) >= 0).all()
    rows = op09_toxicity.grade(frame(spark, [clean[260], toxic[65]]), model).orderBy("doc_id").collect()
    assert [x["toxic"] for x in rows] == [False, True] and rows[0]["severity"] < rows[1]["severity"]
    assert [x["doc_id"] for x in op09_toxicity.reject(frame(spark, [clean[260], toxic[65]]), model).collect()] == [0]
    assert op09_toxicity.train(clean, [0] * 300) is None


def test_ordinal_fit_is_the_optimum():
    """The loss by its definition, minimised by small plain steps from another start, is no lower than that of the fit."""
    r = np.random.default_rng(8)
    n, width = 80, 4
    x = (r.random((n, width)) < 0.4) * r.random((n, width))
    grade = np.clip((x @ [3, 2, 0, 1] + r.normal(0, 0.8, n)).astype(int), 0, 3)
    weight = np.where(grade > 0, 0.5 / (grade > 0).sum(), 0.5 / (grade == 0).sum())
    def loss(w, cut):
        edge = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(cut - (x @ w)[:, None])), np.zeros((n, 1))], axis=1)
        p = edge[np.arange(n), grade] - edge[np.arange(n), grade + 1]
        return -(weight * np.log(np.maximum(p, 1e-12))).sum() + op09_toxicity.RIDGE / 2 * (w @ w)
    rows, cols = np.nonzero(x)
    w, cut = op09_toxicity.fit_ordinal(rows, cols, x[rows, cols], grade, width)
    assert (w >= 0).all() and (np.diff(cut) >= op09_toxicity.GAP - 1e-9).all()
    best, at, step = loss(w, cut), np.array([1.0, 1, 1, 1, 0, 2, 4]), 0.5
    def proper(z):
        return (z[:width] >= 0).all() and (np.diff(z[width:]) >= op09_toxicity.GAP).all()
    value = loss(at[:width], at[width:])
    while step > 1e-5:  # moves along random directions, as long as they help
        moved = False
        for _ in range(60):
            z = at + step * r.normal(size=len(at))
            if proper(z) and (v := loss(z[:width], z[width:])) < value:
                at, value, moved = z, v, True
        step *= 1.0 if moved else 0.7
    assert best <= value + 1e-3 and value < loss(np.ones(width), np.array([0.0, 2, 4]))


# ---- 10 pages --------------------------------------------------------------------------------------------------------

TEXT = "A paragraph of the story, long enough, with commas, to count as prose of its own. "


@pytest.mark.parametrize(
    "page, expected",
    [
        (f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>'</script></head><body><nav><ul><li><a href=/a>Menu</a></ul></nav><article><h1>Head &amp; tail</h1><p><b>{TEXT}<br><p>More&nbsp;text &lt;x&gt;</p></article><footer>&copy; f</footer></body>", f"Head & tail\n\n{TEXT.strip()}\n\nMore text <x>"),
        (f"<body><header>Site</header><div id=sidebar-left><p>{TEXT * 5}</p></div><div class=story><p>{TEXT}</p><p>{TEXT}</p><ul><li>one<li>two</ul></div><div class='comments'><p>{TEXT * 9}</p></div>", f"{TEXT.strip()}\n\n{TEXT.strip()}\n\none\n\ntwo"),
        (f"<main><div class=cookie-notice>{TEXT * 3}</div><p>{TEXT}<aside>{TEXT}</aside><form><p>{TEXT}</p></form><p>Last one", f"{TEXT.strip()}\n\nLast one"),
        (f"<article><p>{TEXT}</p><div class='ad'>{TEXT}</div><table><tr><td>a<td>b<tr><td>c</table><pre>x\n  y</pre></article>", f"{TEXT.strip()}\n\na\n\nb\n\nc\n\nx y"),
        (f"<div><p>{TEXT}</p><ul><li><a>{TEXT}</a><li><a>one more link</a><li><a>and another</a></ul></div>", TEXT.strip()),
        ("plain", "plain"), ("<", "<"), ("<p", ""), ("<!-- x", ""), ("<p>a<!-- <p>b</p> -->c", "ac"), ("<script>never closed", ""), ("a</div></p></article>b", "a\n\nb"),
    ],
)
def test_main_text(page, expected):
    assert op10_html.main_text(page) == expected
