"""Documents: tokens and their places, mixes, and prose against everything else."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, quality, shapes, tokens

TEXTS = [None, "", " ", "plain words", "naïve 漢字 👩‍👩‍👧 ­ x", "<|endoftext|> is text", "a" * 3000, "don't  stop\n\n\tnow", "x\u0000y", "é" * 50]


def documents(spark, texts, source=None):
    rows = [(k, t, (source or ["s"])[k % len(source or ["s"])]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS ids", "2 AS tokens", "3 AS guess", "4 AS rate")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_and_round_trip(spark, plain):
    docs = documents(spark, TEXTS)
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(docs).collect()}
    assert got == {k: plain(t) for k, t in enumerate(TEXTS)}
    assert tokens.round_trip(docs).where("NOT whole").count() == 0
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(docs)).collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}
    assert tokens.encode_corpus(docs.limit(0)).count() == 0


def test_offsets(spark):
    for r in tokens.encode_with_offsets(documents(spark, TEXTS)).collect():
        text = TEXTS[r.doc_id] or ""
        assert len(r.ids) == len(r.starts) == len(r.ends)
        whole = [tokens.byte_table(tokens.TOKENIZER)[i] for i in r.ids]
        for piece, a, b in zip(whole, r.starts, r.ends, strict=True):
            assert piece in text[a:b].encode()


@pytest.mark.parametrize("seed", range(3))
def test_pieces(plain, seed):
    rng = random.Random(seed)
    parts = ["ship", " ", "  ", "\n", "漢", "don't", "12", "'s", "!?", "\t", "é"]
    text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(3000))
    assert "".join(tokens.pieces(text, 50)) == text and len(tokens.pieces(text, 50)) > 20
    assert next(tokens.encode([text], size=50)).tolist() == plain(text)


def test_split_characters():
    ids = next(tokens.encode(["👩"])).tolist()
    assert len(ids) > 1 and tokens.decode_stream(ids)[:-1] == [""] * (len(ids) - 1) and "".join(tokens.decode_stream(ids)) == "👩"
    assert tokens.decode(ids[:1]) == "�" and tokens.decode([]) == "" and tokens.decode([10**9]) == ""


def test_mix(spark, plain):
    texts = ["some words of text " * (k % 7 + 1) if k % 11 else None for k in range(400)]
    docs = documents(spark, texts, ["a", " A", "b", None, "c"])
    size = {}
    for k, t in enumerate(texts):
        s = ["a", "a", "b", None, "c"][k % 5]
        size[s] = size.get(s, 0) + len(plain(t))
    rows = [(1, "a", 0.5, 2, 4000), (1, "b", 0.5, 3, 4000), (2, "b", 0.6, 1, 100_000), (2, "gone", 0.4, 9, 100_000), (3, "c", 0.0, 0, 10)]
    targets = spark.createDataFrame(rows, "mix_id int, source string, weight double, max_repeats int, total_tokens bigint")
    want = {(m, s) for m, s, w, r, t in rows if w * t > r * size.get(s, 0)}
    assert {tuple(r) for r in mixing.capped_sources(docs, targets).collect()} == want
    used = mixing.mix(docs, targets)
    counted = {(r.mix_id, r.source): (r.t, r.c) for r in used.groupBy("mix_id", "source").agg(F.sum("tokens").alias("t"), F.max("copy").alias("c")).collect()}
    for r in mixing.shares(docs, targets).collect():
        got, copies = counted.get((r.mix_id, r.source), (0, 0))
        assert got == r.used_tokens and (copies or 0) <= r.max_repeats
        assert r.capped or abs(got - r.weight * r.total_tokens) <= 0.2 * r.weight * r.total_tokens
    assert mixing.mix(docs.limit(0), targets).count() == 0


PROSE = "The crew saw a small boat near the old pier and the watch officer wrote down the heading of it. "


def corpus():
    rng = random.Random(3)
    words = "the crew saw a boat near pier and officer wrote of it in rain when light came on to was for with lens".split()
    texts = {k: " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(8, 16))).capitalize() + "." for _ in range(rng.randint(1, 6))) for k in range(120)}
    cases = {
        200: ("- radar mast\n- a grey boat\n- deck cargo\n- crane arm\n- fender\n- trawler", "list"),
        201: ("radar mast; a grey boat; deck cargo; crane arm; fender; gangway; trawler", "list"),
        202: ("frame,time,class\n" + "\n".join(f"{k},{k * 7.1:.2f},trawler,0.5,1" for k in range(9)), "table"),
        203: ("\n".join(f"| {k} | boat | {k / 3:.2f} |" for k in range(9)), "table"),
        204: ("\n".join(f"vessel: Abc{k}\nclass: tug\nlength_m: {k}.5" for k in range(5)), "table"),
        205: ("%$#@!^&*()[]{}<>|\\~`+=" * 9, "junk"),
        206: ("Home | Login | Upload | Help\n" * 12, "junk"),
        207: ("00000000  8c 4a 98 f1 fa 55 70 eb 50 8b\n" * 2 + "00000010  48 a6 9a 00 5b aa 83 4b 8d 3d\n", "junk"),
        208: ("kvth nz bctlt jvjkb vpxcmdp wmgjzlt vrtxx qykh trsktm pqrhh vflzn cgbmzqw czcgzl tbvgkmm", "junk"),
        209: (PROSE.lower().replace(". ", ", ").strip(", "), None),
        210: (texts[5] + texts[6] + PROSE + "\n- fender\n- crane", None),
        211: (PROSE.strip() + "\n" + "\n".join(f"{k}\t{k * 3}\ttrawler\t0.5" for k in range(60)), "table"),
        212: (None, None), 213: ("", None), 214: (" \n\t ", None), 215: ("Ã\x83Â©t¤ ©ÂŸ �� Ã¼¶ ÂÃ©Ÿ¤ " * 8, "junk"),
    }
    return texts | {k: t for k, (t, _) in cases.items()}, {k: kind for k, (_, kind) in cases.items()}


def test_quality(spark):
    texts, want = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").selectExpr("*", "1 AS whole", "2 AS runs", "3 AS kind")
    common = spark.createDataFrame([("en", w) for w in "the a and of it in to was for with on when".split()] + [(None, "x"), ("de", "der")], "lang string, word string")
    table = quality.statistics_table(docs, common)
    rows = {r.doc_id: r for r in table.collect()}
    assert {k: rows[k].kind for k in want} == want
    assert sum(rows[k].kind is not None for k in range(120)) == 0 and len(rows) == len(texts)
    assert rows[212].chars == 0 and rows[212].distance is None
    adds = sum(rows[205][f"{s}_adds"] for s in quality.STATISTICS)
    assert abs(adds - rows[205].distance ** 2) < 1e-6 * adds
    assert quality.document_quality(docs.limit(0), common).count() == 0


def test_distance_decides(spark, monkeypatch):
    """Without the distance nothing is told from prose; without prose to compare with nothing is judged."""
    texts, want = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    common = [("en", w) for w in "the a and of it in to was for with on when".split()]
    key = tuple(sorted(common))
    pairs = spark.createDataFrame(common, "lang string, word string")
    units = quality.measured(docs, pairs)
    prose = quality.fit(units)
    m = quality.measure([texts[205]], key)
    parts, z = prose.contributions("en", m["run_stats"], quality._shrink(m["run_words"], m["run_trigrams"]))
    assert parts.sum() > quality.OUTLIER and quality._kinds(parts, z).tolist() == [0]
    monkeypatch.setattr(quality, "OUTLIER", np.inf)
    assert quality._kinds(parts, z).tolist() == [3]
    nothing = quality.document_quality(docs.where("doc_id < 9"), pairs.where("word = 'x'")).collect()
    assert len(nothing) == 9 and all(r.kind is None and r.distance is None and r.lang_guess == "und" and r.chars > 0 for r in nothing)


@pytest.mark.parametrize("seed", range(4))
def test_counts(seed):
    """The counts over arrays are those of a loop over lines and tokens."""
    rng = random.Random(seed)
    bits = ["Boat", "the", " ", "  ", "\t", "\n", "\r\n", "12", "x7", ",", ". ", "é", "漢", "👩", "\u00ad", "|", "®", "-", "a=1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(30)] + ["", "\n \n"]
    known = np.array(sorted(shapes.word_digest(w) for w in ("the", "boat")), np.uint64)
    of, counts, hits = shapes.count_runs(texts, (known, np.ones((2, 1))))
    total = lambda c: np.bincount(of, weights=counts[:, shapes.COUNTS.index(c)], minlength=len(texts)).astype(int).tolist()
    plain = [t.replace("\u00ad", "") for t in texts]
    words = [re.findall(r"[^\W\d_]+", t.lower()) for t in plain]
    assert total("words") == [len(w) for w in words] and total("letters") == [sum(map(len, w)) for w in words]
    assert total("tokens") == [len(t.split()) for t in plain] and total("chars") == [sum(map(len, t.split())) for t in plain]
    assert total("digits") == [sum(map(str.isdigit, t)) for t in plain] and total("lines") == [sum(bool(x.strip()) for x in t.splitlines()) for t in plain]
    assert np.bincount(of, weights=hits[:, 0], minlength=len(texts)).astype(int).tolist() == [sum(x in ("the", "boat") for x in w) for w in words]
    assert total("numbers") == [sum(any(map(str.isdigit, x)) and not any(map(str.isalpha, x)) for x in t.split()) for t in plain]


def test_long_text():
    """A very long text is measured whole."""
    m = quality.measure([PROSE * 20000, PROSE], (("en", "the"),))
    assert m["words"].tolist() == [20 * 20000, 20] and m["of"].max() == 1
