"""Operators whose results are functions of one row, or of one row and a model."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import audio, html, lm, packing, quality, secrets, toxicity
from gridloom.llm.queries import tokenizer_path
from tests.llm.cases import documents, frame, labels

ROWS = documents()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(row):
    return (row["doc_id"] is None, row["doc_id"] or 0, str(row))


# packing


def test_encoder_gives_the_tokenizers_ids():
    encoder, rng = packing.Encoder(tokenizer_path(), most_kept=50), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b'll", "é", "12", ".", " \n ", " ", "<|endoftext|>", "\x1c", "日本", "'s", "!?", "\x85", "word,", "Word."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert encoder.ids(text) == encoder.encode(text), repr(text)


@pytest.mark.parametrize("n", [1, 127, 128, 129, 700, 1023, 1024, 1025, 5000])
def test_cut_covers_a_document(n):
    pieces = packing.cut(n, 1024, 128)
    assert sum(pieces) == n and all(0 < p <= 1024 for p in pieces)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(frame(spark, ROWS), tokenizer_path(), 64, 8).collect()
    used = {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 64
    ids = sorted(((r["doc_id"] is None, r["doc_id"], r["start"], r["ids"]) for r in got), key=lambda x: (x[0], x[1] or 0, x[2]))
    for doc_id, text, *_ in ROWS:
        if doc_id not in (None, 7):
            whole = b"".join(x[3] for x in ids if x[1] == doc_id)
            assert np.frombuffer(whole, "<u4").tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    assert len(got) >= len(ROWS)


def test_packing_of_an_empty_table(spark):
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


# audio


def test_wave_round_trip():
    for n in (0, 1, 575, 576, 577, 5000):
        data = bytes(random.Random(n).randbytes(n))
        payload = audio.padded(data)
        assert len(payload) % 576 == 0 and payload and payload.startswith(data) and set(payload[n:]) <= {255} and len(payload) - n < 576 + (n == 0)
        assert audio.from_wave(audio.to_wave(payload)) == (payload, audio.RATE)


def test_resampling_keeps_a_slow_tone_and_removes_a_fast_one():
    t = np.arange(8000) / 8000
    slow, fast = (np.sin(2 * np.pi * f * t).astype(np.float32) for f in (200, 3500))
    for up, down in ((1, 2), (2, 3), (3, 2)):
        y = audio.resample(slow, up, down)
        assert len(y) == -(-8000 * up // down)
        at = np.arange(len(y)) * down / up / 8000
        assert np.abs(y - np.sin(2 * np.pi * 200 * at))[100:-100].max() < 0.05
    assert np.abs(audio.resample(fast, 1, 2))[100:-100].max() < 0.05


def test_hysteresis_segments():
    assert audio.segments(np.array([0, 5, 2, 2, 0, 2, 5, 5.0]), 4, 1) == [(1, 4), (6, 8)]
    assert audio.segments(np.zeros(3), 4, 1) == []


def test_audio_features_of_a_table(spark):
    got = audio.features(frame(spark, ROWS)).collect()
    by_text = {}
    assert len(got) == len(ROWS)
    for r in got:
        payload, _ = audio.from_wave(r["media"])
        assert hashlib.sha256(payload).hexdigest() == r["payload_sha256"] and hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"]
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["media_bytes"] == len(r["media"])
        table = pa.ipc.open_stream(r["tensors"]).read_all()
        blocks = table["log_mel"].combine_chunks().to_numpy_ndarray() if table.num_rows else None
        assert blocks.shape[1:] == (audio.FRAMES_PER_BLOCK, audio.N_MELS) and blocks.shape[0] == -(-r["n_frames"] // audio.FRAMES_PER_BLOCK)
        assert by_text.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]
    assert audio.features(frame(spark, [])).count() == 0


# secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_find_has_the_base_spans():
    rng = random.Random(5)
    parts = ["password", "Secret", "TOKEN", "api_key", "apikey", '"', "'", " ", ":", "=", "abc", "deadbeef", "0123456789", "AKIA", "ABCDEFGHIJKLMNOP", "é", "ſecret", "\n", "x_y.z"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert [s for s in secrets.find(text) if s[0] in secrets.BASE] == base_spans(text)


def test_ledger_scans_each_blob_once(spark, tmp_path, monkeypatch):
    ledger = str(tmp_path / "ledger")
    docs = frame(spark, ROWS)
    got = secrets.scan(docs, ledger).collect()
    assert len(got) == len(ROWS)
    by_id = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in got}
    for doc_id, text, *_ in ROWS:
        assert [s for s in by_id[doc_id] if s[0] in secrets.BASE] == base_spans(text or "")
    blobs = spark.read.parquet(ledger)
    assert blobs.count() == len({r[1] or "" for r in ROWS}) == blobs.select("blob").distinct().count()
    secrets.scan(docs, ledger).collect()
    assert spark.read.parquet(ledger).count() == blobs.count()  # nothing was left to scan
    more = frame(spark, [(900, "passwd: abcdefgh", "en", "s", 16), *ROWS[:3]])
    assert [len(r["spans"]) for r in secrets.scan(more, ledger).where("doc_id = 900").collect()] == [1]
    assert spark.read.parquet(ledger).count() == len({r[1] or "" for r in ROWS}) + 1
    monkeypatch.setattr(secrets, "RULE_VERSION", 2)  # new rules see all blobs again
    secrets.scan(docs, ledger).collect()
    assert spark.read.parquet(ledger).where("rule_version = 2").count() == len({r[1] or "" for r in ROWS})


def test_redaction(spark):
    docs = frame(spark, ROWS)
    got = secrets.redacted(docs)
    assert got.columns == docs.columns and got.count() == len(ROWS)
    by_id = {r["doc_id"]: r for r in got.collect()}
    for doc_id, text, _, _, n in ROWS:
        r = by_id[doc_id]
        if not base_spans(text or ""):
            assert r["text"] == text and r["n_chars"] == n
        else:
            assert "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"]) and "hunter2222" not in r["text"]


# toxicity


def test_toxicity_separates_held_out_rows(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        words = [rng.choice(["river", "stone", "cloud", "green", "walk", "see"]) + rng.choice(["", "s", "ed", "ing", "let"]) for _ in range(rng.randint(30, 80))]
        if i % 6 == 0:
            words[5] = "grobnak" + rng.choice(["s", "ly", "er", "est"])  # variants; some only held-out rows have
        rows.append((i, " ".join(words), "en", "s", 1))
    marks = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)], "doc_id bigint, quality int, toxic int")
    got = toxicity.scores(frame(spark, rows), marks).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)
    kept = toxicity.without_toxic(frame(spark, rows), marks)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["predicted"]}


def test_toxicity_of_awkward_rows(spark):
    got = toxicity.scores(frame(spark, ROWS), labels(spark, ROWS)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    nothing = labels(spark, []).where("doc_id = -1")
    assert {r["predicted"] for r in toxicity.scores(frame(spark, ROWS), nothing).collect()} == {0}
    assert toxicity.scores(frame(spark, []), nothing).count() == 0


# quality


def brute_statistics(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark):
    rng = random.Random(4)
    texts = ["a b c\na b c\n\n a\n", "x " * 40, "p q r s t u v w " * 2, "###|<>&&%$*", "\n\n", "\x1c\x85  "]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", " ", "#"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = ROWS[:60] + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in quality.statistics(frame(spark, rows)).withColumn("base_failed", quality.base_failed()).collect()}
    for doc_id, text, *_ in rows:
        r, e = got[doc_id], brute_statistics(text or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == e, text
        assert r["base_failed"] == (e[0] < 20 or 100 * e[4] > 30 * e[0])


def test_a_list_is_learned_and_keeps_the_clean(spark):
    rng = random.Random(8)
    good = [" ".join(rng.choice(["river", "stone", "tree", "sky"]) + str(rng.randint(0, 999)) for _ in range(40)) for _ in range(120)]
    bad = [" ".join(w + "***" for w in t.split()) if i % 2 else t.upper() for i, t in enumerate(good[:60])]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(good + bad)]
    marks = spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id bigint, quality int, toxic int")
    got, rules = quality.judged(frame(spark, rows), marks)
    kept = {r["doc_id"] for r in got.where("kept").collect()}
    assert rules.rules and "bad if" in str(rules)
    assert kept >= set(range(120)) and len(kept) <= 123
    assert "Python" not in got._jdf.queryExecution().toString()


def test_quality_without_labels_or_rows(spark):
    none = labels(spark, ROWS).where("doc_id = -1")
    got, rules = quality.judged(frame(spark, ROWS), none)
    assert not rules.rules and got.where("kept = base_failed").count() == 0 and got.count() == len(ROWS)
    assert quality.judged(frame(spark, []), none)[0].count() == 0


# language model


def test_base_scores_and_probabilities(spark):
    got = {r["doc_id"]: r for r in lm.scores(frame(spark, ROWS), most_common=20).collect()}
    tokens = [(r[0], (r[1] or "").encode().lower().split() + [b"\n"]) for r in ROWS]
    counts = Counter()
    for doc_id, own in tokens:
        if zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1:
            counts.update(own)
    total, distinct = sum(counts.values()), len(counts)
    for doc_id, own in tokens:
        r = got[doc_id]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), total)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    all_in_head = {r["doc_id"]: r["score"] for r in lm.scores(frame(spark, ROWS)).collect()}
    assert all(all_in_head[k] == pytest.approx(r["score"], abs=1e-6) for k, r in got.items())
    assert lm.scores(frame(spark, [])).count() == 0


def test_spellings_are_a_distribution(spark):
    """Over all continuations of a beginning by one byte, the probabilities sum to one."""
    words = [w.encode() for r in ROWS if r[1] for w in r[1].split()]
    table = np.zeros(2 * lm.STARTS[-1], np.uint8)
    _, bit, _, slots, _ = lm.bits_of(words)
    for i in range(len(lm.TABLE_BITS)):
        at, n = np.unique(slots[i] * 2 + bit.astype(np.int64), return_counts=True)
        table[at] = np.searchsorted(lm.LEVELS, n).clip(0, 255)
    mixer = lm.Mixer.fresh()
    mixer.run(table, words[:500], True)
    alone = [mixer.run(table, [bytes([b])], False)[0] for b in range(256)]
    ends = [mixer.run(table, [bytes([b]) + bytes([c])], False)[0] for b in (97, 122) for c in range(256)]
    assert sum(10**x for x in alone) <= 1.0001 and sum(10**x for x in ends) <= 1.0001
    learned = mixer.run(table, words, False).mean()
    assert learned > lm.Mixer.fresh().run(np.zeros_like(table), words, False).mean() + 1


def test_weights_and_map_are_learned_from_all_words(spark):
    words = spark.range(400_200).selectExpr("cast(conv(id, 10, 36) as binary) AS word")
    table = spark.sparkContext.broadcast(np.zeros(2 * lm.STARTS[-1], np.uint8))
    bits = 8 * words.selectExpr("sum(length(word) + 1) AS n").first()["n"]
    assert lm.learned(words, table).map[:, 1].sum() == bits


def test_kinds_are_estimated_from_all_training_texts(spark):
    rows = [(i, f"w{i % 10} w{i % 10} common a{i % 3}", "en", "s", 1) for i in range(400)]
    found = lm.kinds(frame(spark, rows), 1, 10)
    assert set(found.number) == {b"common", *(b"w%d" % i for i in range(10)), *(b"a%d" % i for i in range(3))}
    n = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(400))
    # shares of n texts, each of which counts one in all, and one more for every kind
    assert np.exp(found.share).sum() == pytest.approx((n + lm.KINDS) / (n + lm.KINDS)) and np.exp(found.share).min() >= 0.99 / (n + lm.KINDS)
    assert found.tokens.shape == (len(found.number) + 1, lm.KINDS)


def test_the_order_of_words_counts(spark):
    line = "one fine morning the quick brown fox jumped over that lazy old dog by the river bank"
    rows = [(i, f"{line} {i}", "en", "s", 1) for i in range(60)] + [(1000, line, "en", "s", 1), (1001, " ".join(sorted(line.split())), "en", "s", 1)]
    got = {r["doc_id"]: r for r in lm.scores(frame(spark, rows)).collect()}
    assert got[1000]["base_score"] == pytest.approx(got[1001]["base_score"]) and got[1000]["score"] > got[1001]["score"] + 5


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()


def test_texts_that_stand_twice_score_apart(spark):
    """A text's share of the other training texts, by brute force, is the least that its score says."""
    got = lm.scores(frame(spark, ROWS)).collect()
    training = Counter(b" ".join(lowered(r[1])) for r in ROWS if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 != 1)
    n, doubled = sum(training.values()), sum(v for v in training.values() if v > 1)
    weight = (doubled + 0.5) / (n + 1)
    texts = defaultdict(list)
    for r in ROWS:
        texts[r[0]].append(b" ".join(lowered(r[1])))
    seen = 0
    for r in got:
        if len(set(texts[r["doc_id"]])) == 1:
            others = training[texts[r["doc_id"]][0]] - (not r["held_out"])
            if others:
                seen += 1
                assert r["score"] >= math.log10(weight * others / (n - 1)) - 1e-9
                assert r["n_tokens"] < 5 or r["score"] / r["n_tokens"] > -0.7
            elif r["n_tokens"] > 20:
                assert r["score"] / r["n_tokens"] < -0.7
    assert seen >= 4


# HTML


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<div class="topbar">Site name</div><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Head &amp; shoulders</h1><p><b>One<br>two<p>three
   &lt;four&gt;<div class="ad">buy</div><ul><li>a<li>b</ul></article><div class="comments"><p>me too</div><footer>&copy; x</footer>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head & shoulders\n\nOne two\n\nthree <four>\n\na\n\nb"
    assert html.main_text("") == "" and html.main_text("<p>x") == "x" and html.main_text("plain &amp text") == "plain & text"
    assert html.main_text("<div><p>a<table><tr><td>1<td>2</table>b</div><!-- c --><aside>no</aside>") == "a\n\n1\n\n2\n\nb"
    assert html.main_text("<p title=it's>a</p><p>b</p>") == "a\n\nb" and html.main_text("<!--><p>x</p>") == "x" and html.main_text("<![CDATA[a]]>b") == "b"
    assert html.main_text("<article><header><h1>Title</h1><div>by</div></header><p>x</p></article>") == "Title\n\nx"
    assert html.main_text("<p class=share-price>1</p><p class='section-header'>2</p><p class='site-header'>3</p><p id=comment-list>4</p>") == "1\n\n2"
    assert html.main_text("<b>" * 20000 + "<p></i>" * 20000 + "x") == "x"
    assert html.main_text("<p>" * 3000 + "deep" + "<div>" * 3000 + "er") == "deep\n\ner"


def test_templates_counted_by_brute_force(spark):
    """Pages without marks or names: what stands on five pages of different texts goes, whatever stands on fewer stays; repeated rows count once."""
    rows = [(i, "http://a.example/x", f"<div><span>on all</span></div><div><b>box {i % 4}</b></div><p>text {i}</p>") for i in range(12)]
    rows += [(None, "http://a.example/x", "<div><i>rare</i></div><p>one</p>")] * 9
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'clash' as host", "'clash' as hash", "'clash' as text")
    got = Counter((r["page_id"], r["text"]) for r in html.extract(df.repartition(3)).collect())
    pages = defaultdict(set)
    for _, _, source in rows:
        root = html.parsed(source)
        for h in html.subtree_hashes(root).values():
            pages[h].add(html.text_of(root))
    recurring = {h for h, texts in pages.items() if len(texts) >= 5}
    assert len(recurring) == 2  # the box and the text in it
    assert got == Counter((r[0], html.main_text(r[2], recurring)) for r in rows)
    assert got[(3, "box 3\n\ntext 3")] == 1 and got[(None, "rare\n\none")] == 9


def test_templates_are_removed_per_host(spark):
    def page(i, body):
        return f"<body><div class=x><span>Our site since 1999</span> {'' if i else ''}</div><section><p>{body}</p></section></body>"

    rows = [(i, f"http://a.example/{i}", page(i, f"Story {i} of many words")) for i in range(12)]
    rows += [(100 + i, f"http://b{i}.example/", page(i, f"Other {i}")) for i in range(3)] + [(200, None, None), (201, "nonsense", ""), (202, "http://A.example:80/z", PAGE)]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert got[3]["text"] == "Story 3 of many words" and got[101]["text"] == "Our site since 1999\n\nOther 1"
    assert got[200]["text"] == got[201]["text"] == "" and got[200]["n_chars"] == 0 and got[202]["text"].startswith("Head")
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and len(got) == len(rows)


def test_repeated_paragraphs_of_articles_stay(spark):
    rows = [(i, f"http://a.example/{i}", f"<nav>n</nav><div>menu line</div><article><p>Same paragraph</p><p>own {i}</p></article>") for i in range(20)]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert all(r["text"] == f"Same paragraph\n\nown {r['page_id']}" for r in got)
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


PAGES = "page_id bigint, url string, html string"


@pytest.mark.parametrize("most", [0, 1000])
def test_copies_of_a_page_keep_their_text_and_sections_lose_their_notice(spark, monkeypatch, most):
    monkeypatch.setattr(html, "MOST_BROADCAST", most)
    copy = "<html><body><div class=x><p>The whole story</p></div></body></html>"
    rows = [(i, f"http://a.example/{i}", copy) for i in range(8)] + [(10 + i, None, copy) for i in range(8)]
    rows += [(100 + i, f"http://hot.example/{i}", ("<div class=y>Section line</div>" if i < 6 else "") + f"<section><p>Story {i} in many words</p></section>") for i in range(60)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert {got[r[0]] for r in rows[:16]} == {"The whole story"}
    assert all(got[100 + i] == f"Story {i} in many words" for i in range(60))


@pytest.mark.parametrize("mark", ["article", "main"])
def test_recurring_boxes_inside_marked_articles_go(spark, mark):
    box = "<div class=x17><p>Tell a friend</p><ul><li>by post</li></ul></div>"
    rows = [(i, f"http://a.example/{i}", f"<{mark}><p>Same paragraph</p>{box}<div class=body><p>own story {i} of some length</p></div></{mark}>") for i in range(20)]
    rows += [(100 + i, f"http://b.example/{i}", f"<{mark}>{box}<p>own {i}</p></{mark}>") for i in range(4)]  # too few
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == f"Same paragraph\n\nown story {i} of some length" for i in range(20))
    assert all(got[100 + i] == f"Tell a friend\n\nby post\n\nown {i}" for i in range(4))
