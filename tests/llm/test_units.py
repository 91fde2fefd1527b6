"""Pieces of the operators against brute force, without Spark."""

import ctypes
import hashlib
import itertools
import random
import subprocess
import sys
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lodestrata.llm import decontaminate, eliasfano, minhash, ppm, quality, shingles, substring_dedup, tokens, toxicity, workers, wrappers
from lodestrata.llm.pieces import Pieces


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 7, 300, 300, 10**9], list(range(0, 5000, 3)), [0, 2**64 - 1], [2**64 - 1], [5] * 700 + [10**12 + 7 * i for i in range(700)]])
def test_elias_fano_round_trip(values):
    data = eliasfano.encode(np.array(values, dtype=np.uint64))
    read = eliasfano.EliasFano(data + b"more")
    assert read.size == len(data) and list(read) == values
    assert [read.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        read.select(len(values))


def test_elias_fano_stays_small_and_opens_without_a_table():
    values = np.cumsum(np.random.default_rng(3).integers(0, 2000, 40_000))
    data = eliasfano.encode(values)
    assert len(data) * 8 / len(values) < 2 + np.log2(values[-1] / len(values)) + 0.3
    read = eliasfano.EliasFano(data)
    assert not [v for v in vars(read).values() if isinstance(v, (np.ndarray, list, bytes))]


def test_elias_fano_refuses_falling_values():
    with pytest.raises(ValueError):
        eliasfano.encode(np.array([2, 1]))


def test_encoder_matches_the_library():
    own = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "a  b", "x\n\n y ,. z", "!!, a. b", "a_, b.", " lead", "trail ", "tab\t b", "é. ñ, x", "a\0b c", "don't, 's. it's", "...", "你好, 世界。 x", "emoji 😀, ok", "The cat. The  cat,\nsat", "\nNew \nline", " abc*** 12.5", "<|endoftext|> x", "a <|endoftext|>\n\nb", "a"]
    expected = [own.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in own.batch(texts)] == expected and 50256 in expected[texts.index("<|endoftext|> x")]
    plain = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), special_as_text=True)
    assert 50256 not in plain.batch(["<|endoftext|> x"])[0]


def test_shard_documents():
    ids, ends = np.array([5, 6, 0, 0, 7, 0], dtype="<u2"), np.array([3, 4, 6], dtype=np.uint64)
    shard = tokens.Shard(tokens.pack(ids, ends))
    assert [shard.document(i).tolist() for i in range(3)] == [[5, 6, 0], [0], [7, 0]]


def test_decontamination_words_and_offsets():
    text = "Ünïque-WORD 12,x"
    assert decontaminate.words(text) == ["Ünïque".encode(), b"word", b"12", b"x"]
    assert [text[a:b] for a, b in decontaminate.offsets(text)] == ["Ünïque", "WORD", "12", "x"]
    found = decontaminate.Windows([("a", "one two three four"), ("b", "two three"), ("c", None), ("d", "")], window=3)
    spans, items = found.scan(decontaminate.words("zero one two three four two x"))
    assert spans == [[1, 5]] and items == {"a", "b"}


def brute_n_best(model, text, n):
    s = "▁" + text.replace(" ", "▁")
    edges = model.edges(s)

    def rec(j):
        if j == 0:
            yield 0.0, ()
            return
        for start, score, ids in edges[j]:
            for a, b in rec(start):
                yield a + score, b + ids

    return sorted(set(rec(len(s))), key=lambda x: -x[0])[:n]


def test_pieces_n_best_and_round_trip():
    model = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    for _ in range(40):
        text = "".join(rng.choice("theand  \nxé你") for _ in range(rng.randint(1, 9)))
        found = model.n_best(text, 4)
        assert [s for s, _ in found] == [s for s, _ in brute_n_best(model, text, 4)]
        assert all(model.decode(ids) == text for _, ids in found) and len({ids.tobytes() for _, ids in found}) == len(found)
    assert [(score, ids.tolist()) for score, ids in model.n_best("", 3)] == [(0.0, [])] and len(model.encode(None)) == 0
    long = "The quick brown fox. " * 3000
    assert model.decode(model.encode(long)) == long


def test_ppm_is_a_distribution_and_fast_prices_agree():
    rng = random.Random(1)
    data = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(1, 60))) + b"\n" for _ in range(40)]
    grams, _ = ppm.runs(data)
    tables = []
    for k in range(1, ppm.WIDTH + 1):
        v, c = np.unique(grams & np.uint64((1 << 8 * k) - 1), return_counts=True)
        keep = c >= (1 if k < 5 else 2)
        tables.append((v[keep], c[keep]))
    model = ppm.Model(tables)
    for t in range(60):
        context = int(grams[rng.randrange(len(grams))]) >> 8 if t % 2 else int.from_bytes(bytes(rng.choice(b"abcdz \n") for _ in range(5)), "big")
        every = np.array([context << 8 | s for s in range(256)], dtype=np.uint64)
        assert abs((10 ** model.log10(every)).sum() - 1) < 1e-9
        assert np.allclose(model.price(every), model.log10(every), atol=1e-6)
    assert np.isclose(model.scores([b"ab\n", b"\n"])[1], model.log10(ppm.runs([b"\n"])[0])[0], atol=1e-6)
    empty = ppm.Model([(np.zeros(0, np.uint64), np.zeros(0))] * ppm.WIDTH)
    assert np.isclose(empty.scores([b"\n"])[0], -np.log10(256))


def test_ppm_finishes_a_block_in_bounded_memory():
    rng = np.random.default_rng(5)
    vocabulary = [bytes(rng.integers(97, 123, k % 9 + 1).tolist()) for k in range(3000)]
    texts = [ppm.stream([vocabulary[k] for k in rng.integers(0, 3000, n)]) for n in rng.integers(0, 600, 300)]
    streams = [b"\n", b"a\n", *texts * 8, b"\n"]
    body = b"".join(streams)
    assert len(body) > 3_000_000
    grams = np.unique(np.concatenate([np.unique(ppm.runs(streams[k : k + 200])[0]) for k in range(0, len(streams), 200)]))
    prices = -rng.random(len(grams)).astype(np.float32)
    words = sorted(set(body.split()))
    counts = np.append(rng.integers(0, 3, len(words)), 7)
    hashes = ppm.word_hashes(words)
    keys, of = np.unique(hashes), np.argsort(hashes)
    cuts, order = ppm.dealt(ppm.shard_of(grams))
    sent = {k: prices[order[a:b]].tobytes() for k, (a, b) in cuts.items()}
    cuts, order = ppm.dealt(ppm.word_shard(keys))
    sent |= {k: ppm.pack(counts[of][order[a:b]]) for k, (a, b) in cuts.items()}
    columns = {"docs": [list(range(len(streams)))], "size": [len(body)], "body": [pa.compress(body, codec="zstd", asbytes=True)], "shards": pa.array([list(sent)], pa.list_(pa.int32())), "sent": [list(sent.values())]}
    batch = pa.RecordBatch.from_pydict(columns)
    tracemalloc.start()
    out = next(ppm._finish(1000, 100)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(body)
    count = dict(zip(words, counts.tolist(), strict=False))
    for k in [*range(5), 700, 1500, len(streams) - 2, len(streams) - 1]:
        own = [*streams[k].split(), None]
        row = {c: out.column(c)[k].as_py() for c in out.schema.names}
        c = np.array([count.get(w, 7) for w in own])
        assert (row["doc_id"], row["n_tokens"], row["n_known"]) == (k, len(own), (c > 0).sum())
        assert np.isclose(row["base_score"], np.log10((c + 1) / 1101).sum())
        assert np.isclose(row["score"], prices[np.searchsorted(grams, ppm.runs([streams[k]])[0])].astype(float).sum())


def test_adaptive_code_length_learns():
    assert ppm.code_length(b"abcabcabc" * 30) < ppm.code_length(bytes(random.Random(2).choices(range(97, 123), k=270)))
    assert ppm.code_length(b"") == 0


def test_winnowing_keeps_a_phrase_of_every_window():
    rng = random.Random(4)
    words = [str(rng.randint(0, 5)).encode() for _ in range(300)]
    own = shingles.long_grams(shingles.WORD_HASHES.of(words), 5)
    kept = set(shingles.winnow(own, 6).tolist())
    assert all(kept & set(range(i, i + 6)) for i in range(len(own) - 5))
    assert len(shingles.long_grams(own, 500)) == 0
    same = shingles.long_grams(shingles.WORD_HASHES.of([b"a", b"b", b"a", b"b", b"a"]), 2)
    assert same[0] == same[2] != same[1]


def test_shingle_sets():
    assert len(shingles.shingle_set("a b a b", 2)) == 2
    assert len(shingles.shingle_set("A", 2)) == 1 and np.array_equal(shingles.shingle_set("A", 2), shingles.shingle_set(" a\n", 2))
    assert not len(shingles.shingle_set(None, 2)) and not len(shingles.shingle_set(" \t", 2))


def test_similarity_is_exact_at_the_threshold():
    assert minhash.similar(np.arange(5), np.arange(4)) and not minhash.similar(np.arange(10), np.arange(3, 12))


def test_cut_removes_words_and_keeps_the_rest():
    text = " a b  c\td e "
    assert substring_dedup.without(text, [1, 3]) == " a d e " and substring_dedup.without(text, [0, 5]) == " "
    assert substring_dedup.covered(6, [0, 3], 2).tolist() == [True, True, False, True, True, False]


def test_substring_workers_hold_a_part_of_a_batch():
    rng = random.Random(8)
    texts = [None, "", *[" ".join(rng.choices(["ab", "cde", "fghij", "k"], k=rng.randrange(1600))) for _ in range(4000)]]
    ids, starts = pa.array(range(len(texts))), pa.array([[0, 60] if x and x.count(" ") > 120 else [] for x in texts], pa.list_(pa.int32()))
    read, cut, strip = substring_dedup._read(50, 25), substring_dedup._cut(50), substring_dedup._strip
    for run, more in ((read, {}), (cut, {"starts": starts}), (strip, {"__spans": starts})):
        batch = pa.RecordBatch.from_pydict({"doc_id": ids, "tkey": ids, "text": pa.array(texts, pa.string()), **more})
        alone = [run(iter([batch.slice(k, 1)])) for k in (0, 1, 2, 2500, len(texts) - 1)]
        tracemalloc.start()
        rows, at = [], 0
        for out in run(iter([batch])):
            rows += [out.slice(k - at, 1) for k in (0, 1, 2, 2500, len(texts) - 1) if at <= k < at + len(out)]
            at += len(out)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert at == len(texts) and peak < batch.nbytes / 2
        assert [x.to_pylist() for x in rows] == [next(x).to_pylist() for x in alone]


_WORKER = """
import ctypes, random, re, sys
import pyarrow as pa
import public_tokenizers
from lodestrata.llm import pieces

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

class Docs:
    schema = type("Schema", (), {"fields": []})
    def drop(self, *names):
        return self
    def mapInArrow(self, run, schema):
        return run

rng = random.Random(4)
words = ["".join(rng.choices("abcdefghij", k=rng.randrange(1, 9))) for _ in range(20000)]
texts = [" ".join(rng.choices(words, k=400)) for _ in range(2000)]
batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
run = pieces.encode(Docs(), public_tokenizers.path("piece_bpe_32k.model"))
trim = ctypes.CDLL(None).malloc_trim
for out in run(iter([batch, batch])):
    del out
last = held()
pa.default_memory_pool().release_unused()
trim(0)
print(last - held())
"""


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="needs glibc")
def test_workers_keep_no_freed_memory_after_a_task():
    kept = subprocess.run([sys.executable, "-c", _WORKER], capture_output=True, text=True, check=True).stdout
    assert float(kept) < 10


def test_lean_gives_memory_back_after_batches_and_failures(monkeypatch):
    calls = []
    monkeypatch.setattr(workers, "give_back", lambda: calls.append(1))
    assert list(workers.lean(lambda batches: (2 * x for x in batches))(iter([1, 2, 3]))) == [2, 4, 6] and len(calls) == 4
    calls.clear()
    with pytest.raises(ZeroDivisionError):
        list(workers.lean(lambda batches: (1 // x for x in batches))(iter([0])))
    assert calls


def test_wrapper_alignment_and_extraction():
    page = "<html><body><nav><a href=/x>menu</a></nav><div class='ad box'>buy</div><article><h1>T &amp; t</h1><p><b>One<br><p>Two\n  words</p><aside>no</aside></article><footer>f</footer></body></html>"
    assert wrappers.extract(page) == "T & t\n\nOne\n\nTwo words"
    assert wrappers.extract(None) == "" and wrappers.extract("plain  text") == "plain text"
    a, b = ([[x, False, {}] for x in y] for y in (["<p>", "#", "</p>"], ["<p>", "<i>", "#", "</p>"]))
    both = wrappers.align(a, b)
    assert wrappers.expression(both) == "<p> (<i>)? # </p>"
    assert wrappers.match(["<p>", "#", "</p>"], both) == [0, 2, 3] and wrappers.match(["<p>", "<b>", "</p>"], both) == [0, -1, 3]
    folded, place = wrappers.fold("<ul> <li> # </li> <li> # </li> <li> # </li> </ul>".split())
    assert folded == ["<ul>", "(<li> # </li>)+", "</ul>"] and place == [0, *[1] * 9, 2]
    assert wrappers.host("https://a.example.com:80/x") == "a.example.com" and wrappers.host(None) == ""


def test_quality_blocks_cover_the_text():
    assert b"".join(quality._blocks("é" * 5000)) == ("é" * 5000).encode()


def test_string_kernel_tolerates_gaps():
    def kernel(a, b):
        x, y = dict(zip(*toxicity.features(a), strict=True)), dict(zip(*toxicity.features(b), strict=True))
        return sum(v * y.get(k, 0) for k, v in x.items())

    assert kernel("idiot", "idiot") > kernel("idiot", "idi-ot") > kernel("idiot", "teapot")
    table = np.zeros(64**3)
    codes, weights = toxicity.features("idiot")
    table[codes] = weights
    values = toxicity.word_scores("the idiot i d i o t", np.stack([table, 2 * table], axis=1))
    assert np.allclose(values[:, 1], 2 * values[:, 0])
    values = values[:, 0]
    assert np.isclose(values[1], kernel("idiot", "idiot")) and values[2] > values[0]
    assert set(itertools.islice(toxicity.disguised("idiot"), 2)) == {"i.d.i.o.t", "i-d-i-o-t"}
    assert hashlib.sha256(b"").hexdigest()
