"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from lodestrata.llm import decontaminate, embedding_dedup, minhash, pieces, ppm, quality, registry, substring_dedup, tokens, toxicity, wrappers
from lodestrata.llm.components import components
from lodestrata.llm.scratch import Scratch

import public_tokenizers

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(300)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = prose(150, 1)
NEAR = BASE.replace(BASE.split()[40], "changed", 1)
ROWS = [(1, BASE), (2, BASE), (3, NEAR), (4, prose(150, 2)), (5, None), (6, ""), (7, " \n"), (8, "one"), (9, "ONE"), (10, prose(60, 3) + " " + " ".join(BASE.split()[20:90])), (11, prose(20_000, 4)), (4, prose(150, 2))]
SCHEMA = "doc_id long, text string, spans string, n_words string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(a, b, "x", "y", "z") for a, b in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    made.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    made.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in dict.fromkeys(ROWS)])
    return made


def rows(df, *columns):
    return sorted({tuple(r) for r in df.select(*columns).collect()}, key=str)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 2), (7, 8), (8, 8), (5, 4)], "a long, b long")
    assert dict(map(tuple, components(links, Scratch(spark)).collect())) == {3: 2, 4: 2, 5: 2, 9: 2, 8: 7}
    assert components(links.limit(0), Scratch(spark)).count() == 0


def test_minhash_matches_sql(spark, docs, con):
    from lodestrata.llm.q_minhash import SQL

    found = minhash.near_duplicates(docs, Scratch(spark), 2)
    assert found.count() == len(ROWS)
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(con.execute(SQL).fetchall(), key=str)
    assert minhash.near_duplicates(empty(spark), Scratch(spark), 2).count() == 0
    nulls = minhash.near_duplicates(spark.createDataFrame([(None, BASE), (1, BASE)], "doc_id long, text string"), Scratch(spark), 2)
    assert rows(nulls, "doc_id", "component_id") == sorted([(None, None), (1, 1)], key=str)


def test_minhash_joins_a_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = prose(120, 9).split()
    texts = []
    for _ in range(700):
        own = list(base)
        for _ in range(rng.randint(1, 9)):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        texts.append(" ".join(own))
    data = list(enumerate(texts))
    from lodestrata.llm.shingles import shingle_set

    sets = [shingle_set(t, 2) for t in texts]
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if root(i) != root(j) and minhash.similar(sets[i], sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    found = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), Scratch(spark), 2)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: root(i) for i in range(len(data))}


def test_substrings_match_sql(spark, docs, con):
    from lodestrata.llm.q_substring import SQL

    found = substring_dedup.find(docs, Scratch(spark))
    assert found.count() == len(ROWS)
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(con.execute(SQL).fetchall(), key=str)
    cut = substring_dedup.remove_repeats(docs, Scratch(spark))
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[2].strip() == ""
    assert substring_dedup.find(empty(spark), Scratch(spark)).count() == 0


def test_substrings_need_the_automata(spark, docs, con, monkeypatch):
    """Occurrences come from the automata of confirmed phrases alone, for blocks of any size."""
    from lodestrata.llm.q_substring import SQL

    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 500)
    found = substring_dedup.find(docs, Scratch(spark))
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(con.execute(SQL).fetchall(), key=str)
    monkeypatch.setattr(substring_dedup, "_confirm", lambda phrase: lambda batches: iter(()))
    without = {r["doc_id"]: r["n_removed"] for r in substring_dedup.find(docs, Scratch(spark)).collect()}
    assert without[10] == 0 and without[3] == 0 and {r["doc_id"]: r["n_removed"] for r in found.collect()}[10] == 70


@pytest.mark.parametrize("size", [2_000_000, 400])
def test_decontamination_matches_sql(spark, docs, con, size):
    from lodestrata.llm.q_decontaminate import SQL

    items = [(1, " ".join(BASE.split()[10:30])), (2, "One"), (3, None), (4, ""), (2, "One"), (5, prose(40, 2))]
    con.execute("CREATE OR REPLACE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    from pyspark.sql import functions as F

    found = decontaminate.find(docs.select("doc_id", "text"), bench, automaton_bytes=size)
    hit = decontaminate.n_hit()
    own = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long"), F.sha2(F.array_join("hit_items", ","), 256), (hit > 0).alias("c"))
    assert own.count() == len(ROWS)
    assert rows(own, *own.columns) == sorted(con.execute(SQL).fetchall(), key=str)
    left = {r["doc_id"]: r["text"] for r in decontaminate.remove_hits(found).collect()}
    assert left[8] == "" and left[5] is None


def test_tokens_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(BPE)
    out = tokens.read_shards(spark, tokens.write_shards(docs, BPE)).orderBy("start").collect()
    at = 0
    texts: dict = {}
    for a, b in ROWS:
        texts.setdefault(a, b)
    import numpy as np

    for r in out:
        ids = np.array([*tool.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert [r["doc_id"] for r in out] == sorted(a for a, _ in ROWS)
    assert tokens.read_shards(spark, tokens.write_shards(empty(spark), BPE)).count() == 0


def test_tokens_of_rows_without_an_id_and_of_ids_far_apart(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_IDS", 5)
    monkeypatch.setattr(tokens, "PARTITION_BYTES", 10)
    data = [(None, "a b"), (-1, "c"), (None, None), (2**63 - 1, "d d d d d d"), (-(2**63), "<|endoftext|>"), (0, ""), (0, "zero")]
    out = tokens.read_shards(spark, tokens.write_shards(spark.createDataFrame(data, "doc_id long, text string"), BPE)).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, None, -(2**63), -1, 0, 0, 2**63 - 1]
    assert [r["start"] for r in out] == [sum(x["n_tokens"] for x in out[:k]) for k in range(len(out))] and out[2]["n_tokens"] == 2


def test_pieces_keep_rows_and_columns(spark, docs):
    out = pieces.encode(docs.drop("score"), SP)
    assert out.count() == len(ROWS) and all(r["round_trip"] for r in out.select("round_trip").collect())
    assert pieces.encode(empty(spark).drop("score"), SP).count() == 0


def test_pieces_match_every_segmentation(spark):
    """All segmentations of short texts, listed, against the operator's best and N best."""
    model = pieces.Pieces(SP)
    rng = random.Random(21)
    texts = ["".join(rng.choice(["the", "a", "nd", " ", ".", "\n", "é", "你", "x", "ing"]) for _ in range(rng.randint(1, 5))) for _ in range(60)] + ["", None, "a", "a", "▁a b"]

    def every(s, at=0):
        if at == len(s):
            yield 0.0, ()
            return
        hits = [(p, model.pieces.index(s[at : at + size])) for size in range(1, len(s) - at + 1) for p in [at + size] if s[at : at + size] in known]
        if not any(p == at + 1 for p, _ in hits):
            for score, ids in every(s, at + 1):
                yield score + model.unknown, (*(model.byte_ids[b] for b in s[at].encode()), *ids)
        for p, i in hits:
            for score, ids in every(s, p):
                yield score + known[s[at:p]], (i, *ids)

    import numpy as np
    import sentencepiece

    tool = sentencepiece.SentencePieceProcessor(model_file=SP)
    known = {tool.id_to_piece(i): tool.get_score(i) for i in range(tool.vocab_size()) if not (tool.is_control(i) or tool.is_unknown(i) or tool.is_byte(i))}
    out = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "doc_id AS ids", "text AS decoded").repartition(2), SP).collect()
    assert len(out) == len(texts) and list(out[0].asDict()) == ["doc_id", "text", "ids", "n_tokens", "ids_crc32", "score", "n_best_scores", "decoded", "round_trip"]
    for r in out:
        text = texts[r["doc_id"]] or ""
        ways = sorted(every("▁" + text.replace(" ", "▁")), key=lambda w: -w[0]) if text else [(0.0, ())]
        assert r["n_best_scores"] == [w[0] for w in ways[: pieces.N_BEST]] and r["score"] == ways[0][0]
        ids = tuple(np.frombuffer(r["ids"], "<u4").tolist())
        assert ids in {w[1] for w in ways if w[0] == ways[0][0]} and len(ids) == r["n_tokens"] and r["ids_crc32"] == zlib.crc32(r["ids"])
        assert r["decoded"] == text.replace("▁", " ") and r["round_trip"] == ("▁" not in text)


def test_ppm_base_matches_brute_force(spark, docs):
    import math

    out = ppm.score(docs, Scratch(spark)).collect()
    counts: Counter = Counter()
    for d, x in ROWS:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update((x or "").lower().encode().split())
            counts[None] += 1
    total, distinct = sum(counts.values()), len(counts)
    texts = dict(ROWS)
    assert len(out) == len(ROWS)
    for r in out:
        own = [*(texts[r["doc_id"]] or "").lower().encode().split(), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own), rel_tol=1e-9)
        assert r["score"] < 0
    assert ppm.score(empty(spark), Scratch(spark)).count() == 0


def test_ppm_scores_match_brute_force(spark):
    """A trie of dictionaries, read byte by byte with escapes and exclusion."""
    import math

    rng = random.Random(17)
    data = [(i, " ".join(rng.choice(["Ab", "abc", "b", "cab", "é", "x"]) for _ in range(rng.randint(0, 12)))) for i in range(40)] + [(None, "ab zz"), (3, "ab ab"), (50, None), (51, "q" * 400)]
    counts: dict[bytes, Counter] = {}
    for d, x in data:
        if zlib.crc32(str(d).encode()) % 7 != 2 or d is None:
            own = b"\n" * 5 + b" ".join((x or "").lower().encode().split()) + b"\n"
            for i in range(5, len(own)):
                for k in range(6):
                    counts.setdefault(own[i - k : i], Counter())[own[i]] += 1

    def price(context: bytes, symbol: int) -> float:
        out, excluded = 0.0, set()
        for k in range(5, -1, -1):
            seen = counts.get(context[5 - k :], {})
            open_ = {s: n for s, n in seen.items() if s not in excluded}
            if open_:
                total = sum(open_.values())
                if symbol in open_:
                    return out + math.log10((open_[symbol] - 0.5) / total)
                out += math.log10(len(open_) / 2 / total)
            excluded |= set(seen)
        return out - math.log10(256 - len(excluded))

    out = ppm.score(spark.createDataFrame(data, "doc_id long, text string").repartition(3), Scratch(spark)).collect()
    texts = {}
    for d, x in data:
        texts.setdefault(d, set()).add(b"\n" * 5 + b" ".join((x or "").lower().encode().split()) + b"\n")
    assert len(out) == len(data)
    for r in out:
        assert any(math.isclose(r["score"], sum(price(own[i - 5 : i], own[i]) for i in range(5, len(own))), rel_tol=1e-5) for own in texts[r["doc_id"]])


def test_ppm_keeps_every_run_of_the_corpus(spark):
    import math

    import numpy as np

    rng = random.Random(13)
    data = [(i, bytes(rng.choices(range(97, 123), k=900_000)).decode()) for i in range(1, 4)] + [(5, "zq zebra"), (6, "zq zebra"), (None, "x y")]
    train = [ppm.stream(ppm.tokens(x)) for d, x in data if not ppm.held_out(d)]
    grams, _ = ppm.runs(train)
    tables = [np.unique(grams & np.uint64((1 << 8 * k) - 1), return_counts=True) for k in range(1, ppm.WIDTH + 1)]
    assert len(tables[-1][0]) > 1_600_000
    model = ppm.Model(tables)
    out = ppm.score(spark.createDataFrame(data, "doc_id long, text string").repartition(3), Scratch(spark)).collect()
    texts = dict(data)
    assert len(out) == len(data)
    for r in out:
        own, starts = ppm.runs([ppm.stream(ppm.tokens(texts[r["doc_id"]]))])
        assert math.isclose(r["score"], model.log10(own).sum(), rel_tol=1e-5)


def test_classifiers_learn_and_survive_odd_labels(spark):
    rng = random.Random(6)
    good = [(i, prose(80, i)) for i in range(0, 160)]
    bad = [(i, " ".join(w.upper() + "!!" for w in prose(80, i).split())) for i in range(160, 320)]
    rude = [(i, prose(60, i) + " " + rng.choice(["snorgle", "snorgles", "blatfink"]) + " " + prose(60, i + 1)) for i in range(320, 480)]
    data = good + bad + rude
    docs = spark.createDataFrame([*data, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(not 160 <= i < 320), int(i >= 320)) for i, _ in data] + [(None, 1, 1), (5, None, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    for module, label, truth in ((quality, "quality", lambda i: not 160 <= i < 320), (toxicity, "toxic", lambda i: i >= 320)):
        out = module.score(docs, module.fit(docs, labels)).collect()
        held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] < 900]
        assert sum((r["score"] >= 0.5) == truth(r["doc_id"]) for r in held) >= 0.95 * len(held), label
        assert all(0 <= r["score"] <= 1 for r in out) and len(out) == len(data) + 2
        none = module.score(docs, module.fit(docs, labels.where("doc_id < 0"))).collect()
        assert {r["score"] for r in none} == {0.5}
        assert module.score(docs.limit(0), module.fit(docs.limit(0), labels)).count() == 0


def test_toxicity_learns_marks_that_clean_texts_carry_once(spark):
    rng = random.Random(12)
    data = []
    for i in range(600):
        toxic, words = i % 5 == 0, prose(90, 5000 + i).split()
        for k in range(rng.randint(4, 7) if toxic else i % 2):
            words.insert(rng.randrange(len(words)), f"qvorz{rng.choice(WORDS)}" if i % 3 else f"üxzäk{rng.choice(WORDS)}")
        data.append((i, " ".join(words), "de" if i % 3 else "fr", int(toxic)))
    docs = spark.createDataFrame([x[:3] for x in data], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in data], "doc_id long, toxic int")
    for table in (docs, docs.drop("lang")):
        out = {r["doc_id"]: r["score"] for r in toxicity.score(table, toxicity.fit(table, labels)).collect()}
        held = [x for x in data if zlib.crc32(str(x[0]).encode()) % 5 == 0]
        assert sum((out[x[0]] >= 0.5) == bool(x[3]) for x in held) >= 0.95 * len(held)


def test_embeddings_match_sql(spark):
    from lodestrata.llm.q_embedding import SQL

    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    data = [(i, [x + rng.gauss(0, 0.12) for x in centres[i % 12]]) for i in range(240)]
    data += [(300 + i, data[3][1]) for i in range(60)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", data)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    old, embedding_dedup.BLOCK = embedding_dedup.BLOCK, 16
    try:
        found = embedding_dedup.near_duplicates(df, Scratch(spark))
        assert rows(found, "vec_id", "n_links", "component_id", "kept") == sorted(con.execute(SQL).fetchall(), key=str)
    finally:
        embedding_dedup.BLOCK = old
    assert embedding_dedup.near_duplicates(df.limit(0), Scratch(spark)).count() == 0


def test_pages(spark):
    body = "<html><body><nav>menu {i}</nav><article><h1>T{i}</h1><p>a {i}</p><p>b</p></article><footer>x</footer></body></html>"
    plain = "<html><body><div class=top>Site</div><div id=c><p>story {i} one</p><p>story {i} two</p></div><div class=foot>(c)</div></body></html>"
    data = [(i, "http://h.example/" + str(i), body.replace("{i}", str(i))) for i in range(6)] + [(10 + i, "http://p.example/", plain.replace("{i}", str(i))) for i in range(6)] + [(20, None, None), (21, "u", ""), (22, "u", "only text")]
    out = {r["page_id"]: r for r in wrappers.main_text(spark.createDataFrame(data, "page_id long, url string, html string"), Scratch(spark)).collect()}
    assert len(out) == len(data) and out[3]["text"] == "T3\n\na 3\n\nb" and out[3]["n_chars"] == 10
    assert out[12]["text"] == "story 2 one\n\nstory 2 two"
    assert out[20]["text"] == out[21]["text"] == "" and out[22]["text"] == "only text"


def test_pages_that_are_copies_keep_their_text(spark):
    page = "<html><body><div id=c><h2>Title</h2><p>one body</p></div></body></html>"
    data = [(i, "http://c.example/x", page) for i in range(5)] + [(10 + i, None, "plain text") for i in range(4)]
    data += [(20 + i, f"http://v.example/{i}", page.replace("</body>", f"<nav>{i}</nav></body>")) for i in range(5)]
    out = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(data, "page_id long, url string, html string"), Scratch(spark)).collect()}
    assert set(out.values()) == {"Title\n\none body", "plain text"} and out[10] == "plain text" and len(out) == len(data)


def pages_of(spark, data):
    out = wrappers.main_text(spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("page_id", "url", "html", "'x' AS text", "'y' AS host", "1 AS piece"), Scratch(spark))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    return {r["page_id"]: r["text"] for r in out.collect()}


def test_pages_keep_text_whatever_its_classes(spark):
    bodies = ["<body class='no-sidebar'><article class='post has-comments'><p>a {i}</p></article><div class=comments>c {i}</div></body>", "<body><div class='content with-sidebar'><p>a {i}</p></div><div role=complementary>c {i}</div></body>", "<body><form id=f><div><p>a {i}</p></div><nav>c</nav></form></body>", "<body class=search><form><main><p>a {i}</p><form>c</form></main></form></body>", "<body><p>a {i}</p><form><p>c</p></form></body>"]
    bodies.append("<body><div class=menu>c {i}</div><article><p class=comment>a <label class='search-results'>{i}</label></p><article>c {i}</article><aside>c</aside></article></body>")
    data = [(10 * k + i, f"http://k{k}.example/{i}", f"<html>{x.replace('{i}', str(i))}</html>") for k, x in enumerate(bodies) for i in range(4)]
    assert pages_of(spark, data) == {10 * k + i: f"a {i}" for k in range(len(bodies)) for i in range(4)}


def test_pages_are_read_by_the_wrapper_of_their_host(spark):
    """Without an article, only what other pages of the host show tells main text from the rest."""
    page = "<html><body><div><a href=/>Home</a> <b>The Site</b></div><div><h2>T{i}</h2><p>body {i}</p>{more}</div><ul><li><a href=/1>go {i}</a></li><li><a href=/2>on {i}</a></li></ul><p>All rights</p></body></html>"
    data = [(i, f"http://a.example/{i}", page.replace("{i}", "abcdef"[i]).replace("{more}", "<blockquote>only here</blockquote>" if i == 2 else "")) for i in range(6)]
    data += [(100, "http://b.example/", data[0][2])] * 2
    out = pages_of(spark, data)
    assert {i: out[i] for i in range(6)} == {i: f"T{x}\n\nbody {x}" + ("\n\nonly here" if i == 2 else "") for i, x in enumerate("abcdef")}
    assert out[100] != out[0] and "The Site" in out[100]
    alone = {i: wrappers.extract(x) for i, _, x in data[:6]}
    assert all(alone[i] != out[i] for i in alone)


def test_pages_of_many_shapes_are_aligned_in_levels(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN", 2)
    rng = random.Random(31)
    tags = ["h2", "h3", "ul", "pre", "table", "section"]
    data = []
    for i in range(40):
        own = [rng.choice(tags) for _ in range(rng.randint(1, 6))]
        data.append((i, "http://many.example/x", "<html><body><div>Site</div><div>" + "".join(f"<{t}>{t} {i} {k}</{t}>" for k, t in enumerate(own)) + "</div></body></html>"))
    data += [(50, "http://many.example/long", "<html><body><div>Site</div><div>" + "<p>x <b>y</b></p>" * 3000 + "</div></body></html>"), (51, None, None), (52, "http://many.example/", ""), (51, None, None)]
    out = pages_of(spark, data)
    for i in range(40):
        own = out[i].split("\n\n")
        assert own == [x for x in wrappers.extract(data[i][2]).split("\n\n") if x != "Site"] and own
    assert out[50] == "\n\n".join(["x y"] * 3000) and out[51] == out[52] == ""
    assert wrappers.main_text(spark.createDataFrame([], "page_id long, url string, html string"), Scratch(spark)).count() == 0


def test_pages_without_article_keep_all_that_varies(spark):
    page = "<html><body><div class=top><h1>T{i}</h1></div><div id=b><div id=c{i}><p>a {i}</p></div><div id=d><p>long text of page {i}</p><p>b</p></div></div><ul><li>one<li>two<li>three</ul></body></html>"
    data = [(i, f"http://w.example/{i}", page.replace("{i}", "abcd"[i])) for i in range(4)]
    out = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(data, "page_id long, url string, html string"), Scratch(spark)).collect()}
    assert out == {i: f"T{x}\n\na {x}\n\nlong text of page {x}\n\nb" for i, x in enumerate("abcd")}


def test_adverts_and_comments_go_by_the_wrapper(spark, monkeypatch):
    """A slot whose texts return on other pages is no main text, and boxes of a name and a text are comments."""
    ad = ["buy this", "buy that", "win now"]
    div = "<html><body><ul><li><a href=/>x</a></li><li><a href=/>y</a></li></ul><div class=ad>{ad}</div><div><h1>T{i}</h1><p>one {i}</p><p>two {i}</p></div></body></html>"
    talk = "<div><b>Ann</b><p>says {i}</p></div><div><b>Bob</b><p>replies {i}</p></div>"
    art = "<html><body><{e}><h1>T{i}</h1><p>one {i}</p><p>two {i}</p><div>{ad}</div>{talk}<section><h2>More</h2><p>three {i}</p></section></{e}></body></html>"
    data = []
    for i in range(12):
        fill = {"{ad}": ad[i % 3], "{i}": "abcdefghijkl"[i] * 3}
        for k, page in enumerate((div, art.replace("{talk}", talk).replace("{e}", "article"), art.replace("{talk}", talk).replace("{e}", "main"))):
            for a, b in fill.items():
                page = page.replace(a, b)
            data.append((100 * k + i, f"http://h{k}.example/{i}", page))
    want = lambda i, more: "\n\n".join([f"T{i * 3}", f"one {i * 3}", f"two {i * 3}"] + more)
    expected = {i: want(x, []) for i, x in enumerate("abcdefghijkl")}
    for k in (1, 2):
        expected |= {100 * k + i: want(x, ["More", f"three {x * 3}"]) for i, x in enumerate("abcdefghijkl")}
    assert pages_of(spark, data) == expected
    alone = {i: wrappers.extract(page) for i, _, page in data}
    assert all(alone[i] != expected[i] for i in alone)  # a page by itself does not show what returns


def test_registry_names_every_operator():
    names = registry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names} and len(corpus_pipeline.STAGES) == 5


def test_quality_filter_keeps_blank_texts_whatever_the_base_rate(spark, tmp_path):
    data = [(i, prose(80, i) if i < 20 else prose(80, i).upper() + "!!" * 40) for i in range(200)] + [(900, None), (901, ""), (902, " \n\u2003")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    spark.createDataFrame([(i, int(i < 20)) for i in range(200)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r["doc_id"] for r in corpus_pipeline.quality_filter(spark, docs, str(tmp_path)).collect()}
    assert {900, 901, 902} <= out and 199 not in out


def test_pipeline_stages_on_a_small_table(spark, tmp_path):
    data = [(i, prose(90, 1000 + i), "en", "s", 1) for i in range(30)]
    data += [(100, data[0][1], "en", "s", 1), (101, prose(40, 77) + " " + " ".join(data[1][1].split()[5:75]), "en", "s", 1), (102, prose(40, 78) + " " + " ".join(data[2][1].split()[:12]), "en", "s", 1), (103, None, "en", "s", 0)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(data[2][1].split()[:12]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(30), 101, 103} - {2}
    assert out[101]["text"].split() == prose(40, 77).split() and all(r["round_trip"] or r["text"] == "" for r in out.values())


def test_pages_stay_where_they_are_if_wrappers_are_small(spark, monkeypatch):
    data = [(k, f"https://h{k % 3}.org/{k}", f"<html><body><nav><a>home</a></nav><article><h1>t {k}</h1><p>{prose(20, k)}</p></article><footer>f</footer></body></html>" if k else None) for k in range(40)]
    pages = spark.createDataFrame([*data, (40, None, "<p>x</p>")], "page_id long, url string, html string")
    sent = wrappers.main_text(pages, Scratch(spark))
    assert "Exchange" not in sent._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(wrappers, "SENT_BYTES", 0)
    joined = wrappers.main_text(pages, Scratch(spark))
    assert "Exchange" in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, joined.collect()))
