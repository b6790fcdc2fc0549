"""The ten operators against plain versions, with nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vellumspark.llm import exact_dedup, katz, packing, piece_viterbi, quality_fm, simhash, tool_calls, toxicity, warc, webp

#: Columns that an operator might use inside.
CLASH = ("_id", "_sha", "h", "n", "uid", "fp", "kept", "k", "root", "held", "_class", "norm", "sha", "slot", "word", "first")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(brute.ROWS, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_exact(docs):
    got = exact_dedup.exact_dedup(docs)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got.collect()) == brute.exact(brute.ROWS)
    groups = {}
    for r in got.collect():
        groups.setdefault(r["text_sha256"], []).append(r["kept"])
    assert all(sum(x) == 1 for x in groups.values())
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_splits_collisions(docs, monkeypatch):
    """With a hash of four bits nearly all texts collide; bytes still tell them apart."""
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.expr(f"concat(repeat('0', 31), substr(sha2({c}, 256), 1, 1))"))
    got = exact_dedup.exact_dedup(docs)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got.collect()) == brute.exact(brute.ROWS)


def test_simhash(docs):
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.contract(docs).collect())
    assert got == brute.components(brute.ROWS, 4)


def signed(x):
    return x - 2**64 if x >> 63 else x


def joined(pairs, nodes):
    """The smallest node that each node reaches."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def near_prints(prints):
    return {(min(a, b), max(a, b)) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}


@pytest.mark.parametrize("long", [1000, 1])
def test_links_are_all_found(spark, monkeypatch, long):
    """Short lists give every pair once; with lists split at two entries, the links that are made join the same groups."""
    monkeypatch.setattr(simhash, "LONG", long)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = [signed(x) for x in {b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 4, 5, 6)}]
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    got, want = [(r["a"], r["b"]) for r in simhash.links(df).collect()], near_prints(prints)
    assert {(min(p), max(p)) for p in got} <= want
    assert joined(got, prints) == joined(want, prints)
    if long == 1000:
        assert sorted(got) == sorted(want)


def test_a_ball_of_fingerprints(spark):
    """2,000 fingerprints around one, with a few that only others of them reach."""
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << k for k in rng.sample(range(64), n)) for n in (1, 2, 3, 4, 5, 6) for _ in range(340)}
    prints = [signed(x) for x in prints | {rng.getrandbits(64) for _ in range(200)}]
    got = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()]
    want = near_prints(prints)
    assert {(min(p), max(p)) for p in got} <= want
    assert joined(got, prints) == joined(want, prints)


def test_simhash_hot_text(spark):
    """10,000 copies of one text are one entry of the index."""
    rows = [(k, "one text that very many rows share") for k in range(10_000)] + [(None, "one text that very many rows share"), (None, "another")]
    got = simhash.contract(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("component_id").count().collect()
    assert sorted(map(tuple, got), key=repr) == [(0, 10_001), (None, 1)]


def test_warc(spark):
    inner = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\nz\r\n\r\ny"
    rows = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, inner), (6, "é\r\n"), (7, "b" * 300_000), (8, "WARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumns({"url": F.lit("http://a b/\r\nWARC/1.1\r\n"), "d": F.lit("clash"), "m": F.lit(1), "k": F.lit(2)})
    got = [tuple(r) for r in warc.contract(pages).collect()]
    assert sorted(got, key=repr) == brute.warc(rows)
    assert warc.contract(pages.limit(0)).count() == 0


def test_warc_reachable_is_a_walk():
    rng = random.Random(2)
    at = np.array(sorted(rng.sample(range(1, 500), 120)) + [600])
    at[0] = 0
    successor = np.array([rng.choice([*at[k + 1 :].tolist(), 10_000]) for k in range(len(at) - 1)] + [700])
    seen, here = set(), 0
    while here in at:
        seen.add(here)
        here = int(successor[list(at).index(here)])
    assert set(at[warc.reachable(at, successor)].tolist()) == seen


def test_packing(docs):
    rows = packing.contract(docs).collect()
    ids = dict(zip([i for i, _ in brute.ROWS], brute.token_ids([t for _, t in brute.ROWS])))
    lengths = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        lengths.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in lengths.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 4096
    assert sum(r["length"] for r in rows) == sum(len(ids[i]) for i, _ in brute.ROWS)


def test_plan_fills_sequences():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 513, 20_000), minlength=513)
    plan = packing.plan(counts, 512)
    used = sum(a * t for a, t in plan)
    assert (used == counts).all() and all((a * np.arange(513)).sum() <= 512 for a, _ in plan)
    assert sum(t for _, t in plan) <= 1.005 * (counts * np.arange(513)).sum() / 512
    assert packing.plan(np.zeros(513, np.int64), 512) == []


def test_pieces_are_the_librarys():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_viterbi.model_path())
    model = piece_viterbi.model(piece_viterbi.model_path())
    rng = random.Random(3)
    texts = ["", " ", "\n\n x", "▁", "aaaaaaaaaaaaaaaa", "漢字é̂𝔸 \x00\t", "def f(x_1):\n    return x_1 == 2"]
    texts += ["".join(rng.choice("abcdefgeiounrst  ▁\né漢-=_/0123.,") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text, raw in zip(texts, model.encode(texts)):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == sp.encode(text)
        assert model.decode(ids) == text.replace("▁", " ")


def test_unigram_scores_are_best():
    model = piece_viterbi.PieceModel(piece_viterbi.model_path(), "unigram")
    model.ids, model.score = {"a": 0, "b": 1, "ab": 2, "ba": 3}, [-1.0, -1.0, -1.5, -3.0]
    model.text, model.byte, model.penalty = ["a", "b", "ab", "ba"], {}, -50.0
    model.endings = {}
    for piece, k in model.ids.items():
        node = model.endings
        for c in reversed(piece):
            node = node.setdefault(c, {})
        node[""] = k
    assert list(model.forward(sorted(["abab", "aba", "b"]))) == [[2, 0], [2, 2], [1]]


def test_pieces_query(docs, nothing):
    rows = {r["doc_id"]: r for r in piece_viterbi.encode(docs).collect()}
    assert rows[4]["n_pieces"] == rows[5]["n_pieces"] == 0 and all(r["round_trip"] for r in rows.values())


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_katz(docs):
    got, want = sorted(tuple(r) for r in katz.score(docs).collect()), brute.katz(brute.ROWS)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(close(g[5], w[5]) and close(g[6], w[6]) for g, w in zip(got, want))


def _some_payloads() -> list[bytes]:
    rng = np.random.default_rng(6)
    words = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(n))) for n in rng.integers(2, 9, 90)]
    texts = [" ".join(words[int(k)] for k in rng.integers(0, 90, int(n))) for n in rng.integers(5, 400, 60)]
    return [webp.payload(x)[0] for x in ["", "ab", "ж" * 700, "\0" * 3000, *texts]] + [rng.bytes(6400), bytes(range(256)) * 9]


def test_payloads_are_written_and_read_together(monkeypatch):
    """Codes of running text are not fitted and read one by one, which took most of the time where texts are short; a transform's are."""
    payloads, calls = _some_payloads()[4:64], {"huffman": 0, "read_code": 0}
    for name in calls:
        monkeypatch.setattr(webp, name, lambda *x, name=name, f=getattr(webp, name): (calls.__setitem__(name, calls[name] + 1), f(*x))[1])
    files = webp.write_batch(payloads)
    monkeypatch.setattr(webp, "STEP", 0, raising=False)
    assert webp.read_batch(files) == payloads
    assert max(calls.values()) < len(files)


def test_a_payload_has_the_same_file_alone_and_among_others():
    payloads = _some_payloads()
    files = webp.write_batch(payloads)
    assert [webp.write_batch([x])[0] for x in payloads] == files == webp.write_batch(payloads[::-1])[::-1]
    for raw, file in zip(payloads, files):
        assert webp.decode(file)[2].astype("<u4").tobytes() == raw


@pytest.mark.parametrize("step", [0, 24, 10**9])
def test_files_read_together_are_as_read_alone(step, monkeypatch):
    """Files of all tools, several code groups and cache sizes included, whichever are read together."""
    monkeypatch.setattr(webp, "STEP", step)
    monkeypatch.setattr(webp, "STREAMS", 30)
    rng = np.random.default_rng(8)
    files = webp.write_batch(_some_payloads())
    for case in range(60):
        w, h, colours = int(rng.integers(1, 40)), int(rng.integers(1, 40)), int(rng.choice([1, 2, 3, 10, 40, 5000]))
        pixels = np.concatenate([[0], rng.integers(0, 2**32, colours)]).astype(np.uint32)[rng.integers(0, colours + 1, w * h)]
        if case % 3 == 0:
            pixels = np.repeat(pixels, 4)[: w * h]
        kinds = [int(t) for t in rng.permutation([webp.PREDICTOR, webp.CROSS, webp.GREEN])[: int(rng.integers(0, 4))]]
        if len(set(pixels.tolist())) <= 256 and case % 2:
            kinds = [webp.PALETTE, *kinds]
        files.append(webp.encode(w, h, pixels, tuple(kinds), int(rng.choice([0, 1, 4, 11])), bool(case % 4), int(rng.integers(2, 6)), int(rng.choice([0, 0, 2, 3]))))
    for file, pixels in zip(files, webp.decode_batch(files)):
        assert (webp.decode(file)[2] == pixels).all()


def test_damaged_files_are_refused_together():
    files = webp.write_batch(_some_payloads()[4:12])
    for bad in (files[0][:60], files[0][: len(files[0]) // 2]):
        for some in ([bad], [bad, *files[1:]]):
            with pytest.raises(ValueError):
                webp.decode_batch(some)


def test_codes_of_many_files_are_those_of_one():
    """Lengths fitted together cost the same bits as those fitted alone, hardly more where the limit binds; written alike."""
    rng = np.random.default_rng(3)
    weights = [(rng.integers(0, 3, 60) * rng.integers(0, 2 ** int(rng.integers(1, 16)), 60)).tolist() for _ in range(50)]
    weights += [[0] * 60, [0] * 59 + [5], [1 << min(k, 20) for k in range(60)]]
    flat, row = np.array(weights).reshape(-1), np.repeat(np.arange(len(weights)), 60)
    for limit in (7, 11, 15):
        got = webp._fitted(flat, row, limit).reshape(-1, 60)
        for w, lengths in zip(weights, got.tolist()):
            cost, least = (sum(x * n for x, n in zip(w, some)) for some in (lengths, webp.huffman(w, limit)))
            free = max(webp.huffman(w, 64)) <= limit
            assert max(lengths) <= limit and (cost == least if free else cost <= 1.02 * least)
            assert sum(1 << (15 - n) for n in lengths if n) == 1 << 15 or sum(n > 0 for n in lengths) < 2
        rows, words, sizes = webp._length_codes(got.reshape(-1), row, len(weights))
        for k, lengths in enumerate(got.tolist()):
            one, many = webp.Writer(), webp.Writer()
            webp.write_code(one, lengths)
            for word, size in zip(words[rows == k].tolist(), sizes[rows == k].tolist()):
                many.write(word, size)
            assert many.bits() == one.bits() and webp.read_code(webp.Bits(many.bytes()), 60) == (lengths if any(lengths) else [1] + [0] * 59)


def test_references_no_farther_than_the_format_reaches():
    """What comes again after over 4 MB is written anew: no distance code reaches it."""
    raw = np.random.default_rng(5).bytes((4 << 20) + 64 * 100)
    raw += raw[:6400]
    file = webp.write_batch([raw])[0]
    assert webp.read_batch([file])[0][: len(raw)] == raw


def test_katz_hot_contexts_and_blocks(docs, monkeypatch):
    """All contexts hot, and a block for every few texts: the same numbers."""
    monkeypatch.setattr(katz, "BLOCK", 300)
    monkeypatch.setattr(katz, "HOT", 10**9)
    got, want = sorted(tuple(r) for r in katz.score(docs).collect()), brute.katz(brute.ROWS)
    assert all(close(g[5], w[5]) and close(g[6], w[6]) for g, w in zip(got, want))


def test_webp_tools():
    rng = np.random.default_rng(1)
    for case in range(40):
        w, h, colours = int(rng.integers(1, 40)), int(rng.integers(1, 40)), int(rng.choice([1, 2, 3, 10, 40, 5000]))
        pixels = rng.integers(0, 2**32, colours, dtype=np.uint32)[rng.integers(0, colours, w * h)]
        if case % 3 == 0:
            pixels = np.repeat(pixels, 4)[: w * h]
        kinds = [int(t) for t in rng.permutation([webp.PREDICTOR, webp.CROSS, webp.GREEN])[: int(rng.integers(0, 4))]]
        if len(set(pixels.tolist())) <= 256 and case % 2:
            kinds = [webp.PALETTE, *kinds]
        file = webp.encode(w, h, pixels, tuple(kinds), int(rng.choice([0, 1, 4, 11])), bool(case % 2), int(rng.integers(2, 6)), int(rng.choice([0, 2, 3])))
        a, b, back = webp.decode(file)
        assert (a, b) == (w, h) and (back == pixels).all()


def test_webp_refuses_damage():
    file = webp.encode(8, 8, np.arange(64, dtype=np.uint32) * 12345, (), 0)
    for bad in (b"", file[:30], b"RIFF" + file[4:12] + b"VP8 " + file[16:]):
        with pytest.raises((ValueError, IndexError, Exception)):
            webp.decode(bad)


def test_media(docs):
    rows = sorted(webp.media(docs, with_file=True).collect(), key=lambda r: r["doc_id"])
    texts = {i: t or "" for i, t in brute.ROWS}
    for r in rows:
        raw, n = webp.payload(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (n, len(raw), zlib.crc32(raw[-64:]))
        assert len(raw) % 64 == 0 and raw
        w, h, pixels = webp.decode(bytes(r["media"]))
        assert pixels.astype("<u4").tobytes()[: len(raw)] == raw
    same = {}
    for r in rows:
        same.setdefault(texts[r["doc_id"]], set()).add(r["media_sha256"])
    assert all(len(x) == 1 for x in same.values())


def test_tool_calls(spark):
    call = lambda name, args, after=(): __import__("json").dumps({"name": name, "arguments": args, "after": list(after)})
    good = {"text": "hi", "turn": 1, "words": 1}
    rows = [
        ("c", 1, "call", "a", call("reply", good)), ("c", 2, "result", "a", "R"), ("c", 3, "result", "a", "later"),
        ("c", 4, "call", "a", call("reply", good)), ("c", 5, "call", "b", call("reply", {"text": "", "turn": "x"}, ["a"])),
        ("c", 6, "call", "u", call("other", {"z": 1, "a": {"y": 2, "b": [3]}})), ("c", 7, "call", "i", "not json"), ("c", 8, "call", None, call("reply", good)), ("c", 9, "result", "zz", "no call"),
        ("d", 1, "call", "x", call("reply", good, ["y"])), ("d", 2, "call", "y", call("reply", good, ["z", "none"])), ("d", 3, "call", "z", call("reply", good)),
        ("e", 1, "call", "p", call("reply", good, ["q"])), ("e", 2, "call", "q", call("reply", good, ["p"])), ("e", 3, "call", "r", call("reply", good)), (None, 1, "call", "n", None),
    ]
    events = spark.createDataFrame(rows, "conv_id string, turn long, kind string, call_id string, payload string").withColumn("level", F.lit("clash"))
    got = {(r["conv_id"], r["turn"]): r for r in tool_calls.link(events).collect()}
    status = {k: r["status"] for k, r in got.items()}
    assert status == {
        ("c", 1): "valid", ("c", 4): "duplicate", ("c", 5): "violates", ("c", 6): "unknown", ("c", 7): "invalid", ("c", 8): "valid",
        ("d", 1): "valid", ("d", 2): "valid", ("d", 3): "valid", ("e", 1): "cycle", ("e", 2): "cycle", ("e", 3): "valid", (None, 1): "invalid",
    }
    assert [got[("d", t)]["level"] for t in (1, 2, 3)] == [2, 1, 0]
    assert got[("c", 5)]["violations"] == ["text:range", "turn:type", "words:missing"]
    assert (got[("c", 1)]["result"], got[("c", 1)]["result_turn"]) == ("R", 2)
    assert got[("c", 6)]["arguments"] == '{"a":{"b":[3],"y":2},"z":1}'
    assert got[("c", 1)]["record"] == '{"arguments":{"text":"hi","turn":1,"words":1},"id":"a","name":"reply","result":"R"}'
    assert tool_calls.link(events.limit(0)).count() == 0


def plain_levels(after):
    """Kahn's levels of {id: needs}; None in or behind a cycle."""
    level = {}
    while True:
        free = [k for k, needs in after.items() if k not in level and all(n in level for n in needs if n in after)]
        if not free:
            return {k: level.get(k) for k in after}
        level |= {k: max((level[n] + 1 for n in after[k] if n in after), default=0) for k in free}


def test_tool_call_levels(spark):
    """Chains and ladders both ways, random graphs with cycles, a hot dependency, equal rows, null ids and turns."""
    rng, graphs = random.Random(12), {}
    graphs["chain"] = {f"a{k}": [f"a{k - 1}"] for k in range(400)}
    graphs["back"] = {f"a{k}": [f"a{k - 1}", f"a{k - 2}"] for k in range(200)}
    graphs["forth"] = {f"a{k}": [f"a{k + 1}", f"a{k + 2}", "none"] for k in range(200)}
    graphs["star"] = {f"a{k}": ["a0"] for k in range(1, 300)} | {"a0": []}
    graphs["rings"] = {"u": ["x"], "x": ["u"], "v": ["u", "x"], "w": ["v"], "self": ["self"], "a": ["b", "c", "d"], "b": ["c"], "c": ["d"], "d": []}
    for g in range(6):
        graphs[f"random{g}"] = {f"a{k}": [f"a{rng.randrange(40)}" for _ in range(rng.randrange(0, 3))] if rng.random() < 0.1 else [f"a{rng.randrange(k)}" for _ in range(rng.randrange(0, 4)) if k] for k in range(40)}
    rows = []
    for conv, after in graphs.items():
        for turn, (call, needs) in enumerate(after.items()):
            rows.append((conv, None if call == "a7" else turn, "call", call, __import__("json").dumps({"name": "reply", "arguments": {}, "after": needs})))
    same = ("twice", 1, "call", "z", '{"name": "reply"}')
    rows += [same, same, same, (None, 1, "call", "z", "{}"), ("", 1, "call", "z", "{}"), ("null", 1, "call", None, "{}"), ("null", 1, "call", None, "{}"), ("null", 2, "result", None, "lost")]
    got = tool_calls.link(spark.createDataFrame(rows, "conv_id string, turn long, kind string, call_id string, payload string")).collect()
    assert len(got) == len(rows) - 1
    level = {(r["conv_id"], r["call_id"]): r["level"] for r in got if r["conv_id"] in graphs}
    assert level == {(conv, call): n for conv, after in graphs.items() for call, n in plain_levels(after).items()}
    assert sorted(r["status"] for r in got if r["conv_id"] == "twice") == ["duplicate", "duplicate", "invalid"]
    assert sorted((r["conv_id"] or "") + str(r["conv_id"] is None) + r["status"] for r in got if not r["conv_id"]) == ["Falseinvalid", "Trueinvalid"]
    assert [(r["status"], r["level"]) for r in got if r["conv_id"] == "null"] == [("invalid", None)] * 2


def labelled_rows():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(600):
        text = " ".join(rng.choices(words, k=60))
        bad, rude = i % 5 == 0, i % 4 == 1
        if bad:
            text = text.upper().replace(" ", "!! ")
        if rude:
            text += " blargh" + rng.choice(["", "s", "ing"]) + " you vexnit"
        docs.append((i, text))
        labels.append((i, int(not bad), int(rude)))
    return docs, labels


def test_classifiers(spark, docs):
    rows, marks = labelled_rows()
    table = spark.createDataFrame(rows + [(9001, None), (9002, ""), (None, "w1 w2")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame(marks + [(9001, None, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in marks}
    quality = quality_fm.contract(table, labels).collect()
    assert len(quality) == 603 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in quality)
    held = [r for r in quality if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]][0] for r in held) / len(held) > 0.98
    tox = toxicity.score(table, labels).collect()
    held = [r for r in tox if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["toxic"] == bool(truth[r["doc_id"]][1]) for r in held) / len(held) > 0.98
    assert all(0 <= r["expected_severity"] <= 3 for r in tox)
    kept = quality_fm.keep(table, labels)
    assert kept.columns == table.columns and 0 < kept.count() < 603


def test_classifiers_without_labels(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_fm.contract(docs, none).collect()} == {0.5}
    assert {r["expected_severity"] for r in toxicity.score(docs, none).collect()} == {0.0}


def test_factorisation_is_the_pair_sum():
    rng = np.random.default_rng(0)
    model = quality_fm.Model(0.3, rng.normal(size=quality_fm.SIZE).astype(np.float32), rng.normal(size=(quality_fm.SIZE, 3)).astype(np.float32))
    i, x = quality_fm.features("Some words, some more words! 12")
    pairs = sum(float(model.factors[a] @ model.factors[b]) * x[j] * x[k] for j, a in enumerate(i) for k, b in enumerate(i) if j < k)
    z = model.bias + float(model.linear[i] @ x) + pairs
    assert math.isclose(model.score([(i, x)])[0], 1 / (1 + math.exp(-z)), rel_tol=1e-4)


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, simhash.contract, packing.contract, piece_viterbi.encode, katz.score, webp.media])
def test_empty_table(nothing, run):
    assert run(nothing).count() == 0


def test_simhash_plans_are_small(spark, monkeypatch):
    """The driver plans and keeps every written-out expression of the index; lists that must be split are planned only where there are any."""
    sizes, kept = {}, simhash.store

    def store(df, label):
        sizes[label] = len(df._jdf.queryExecution().analyzed().toString())
        return kept(df, label)

    monkeypatch.setattr(simhash, "store", store)
    few = spark.createDataFrame([(k << 32 | k,) for k in range(40)], "fp long")
    simhash.links(few).collect()
    assert max(sizes.values()) < 12_000 and "simhash-sliced" not in sizes
    rng = np.random.default_rng(3)
    many = [int(x) for x in np.unique(np.bitwise_xor.reduce(np.int64(1) << rng.integers(0, 62, (1500, 3)), axis=1))]
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(x,) for x in many], "fp long")).collect()}
    assert max(sizes.values()) < 12_000 and "simhash-sliced" in sizes
    root = {x: x for x in many}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        assert (a ^ b).bit_count() <= 4
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for k, a in enumerate(many) for b in many[k + 1 :] if (a ^ b).bit_count() <= 4)


def test_ordinary_payloads_use_the_tools_of_the_format():
    """A running text is stored with references, cache and codes of its own, other payloads with the transform that fits; decode() reads all."""
    rng = np.random.default_rng(4)
    line = " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(n))) for n in rng.integers(2, 9, 60))
    words = line.split()
    text = " ".join(words[int(k)] for k in rng.integers(0, 60, 900))
    smooth = (np.arange(4 * 1600).reshape(-1, 16, 4) * np.array([3, 5, 7, 0]) + rng.integers(0, 3, (100, 16, 4))).astype(np.uint8)
    grey = np.repeat(rng.integers(0, 256, (1600, 1)), 4, 1).astype(np.uint8)
    payloads = [webp.payload(x)[0] for x in ("", "ab", text, text[:400] * 12, "ж" * 5000, "\0" * 3000)] + [smooth.tobytes(), grey.tobytes(), rng.bytes(6400)]
    files = webp.write_batch(payloads)
    for raw, file in zip(payloads, files):
        w, h, pixels = webp.decode(file)
        assert (w, h) == webp.shape(len(raw)) and pixels.astype("<u4").tobytes() == raw.ljust(4 * w * h, b"\0")
    assert webp.read_batch(files) == [raw.ljust(4 * w * h, b"\0") for raw in payloads for w, h in [webp.shape(len(raw))]]
    assert len(files[2]) < 0.6 * len(payloads[2]) and len(files[3]) < 0.2 * len(payloads[3])
    kinds = []
    for file in files:
        bits = webp.open_file(file)[2]
        kinds.append(bits.read(2) if bits.read(1) else None)
    assert kinds[0] == kinds[5] == webp.PALETTE and kinds[2] is None and kinds[6] == webp.PREDICTOR and kinds[7] in (webp.GREEN, webp.CROSS)
    bits = webp.open_file(files[2])[2]
    assert bits.read(1) == 0 and bits.read(1) == 1  # no transform, a colour cache
