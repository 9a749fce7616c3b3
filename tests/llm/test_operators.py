"""The training-data operators against brute force, on whole small tables and odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lehrplan.llm import (ann, components, contamination, language, near, packing, pii, queries,
                          sharding, spans, suffixes, urls)
from tests.conftest import SMALL
from tests.llm import brute as B

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho. "


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, real):
    """All small documents and odd rows, with columns whose names operators use themselves."""
    first = real.agg(F.max("doc_id")).first()[0] + 1
    texts = [None, "", "   \n ", "12345 --- 678", PLAIN * 3, PLAIN * 3, PLAIN * 900, "x" * 400,
             "word", "É" * 150 + " ünï", "\U0001F600 \x00 tab\t", "a@b.c 10.0.0.1 +49 (30) 1234-5678",
             "call +1 555 123 4567 or 4111 1111 1111 1111, 999.1.1.1.1.2.3.4"]
    rows = [(first + i, t, None if i % 2 else "en", None, None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, PLAIN, "de", "s", 5), (None, None, None, None, None)]
    added = real.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        spark.createDataFrame(rows, DOCS))
    clash = {c: F.lit("clash") for c in ("row", "shard", "node", "doc", "first", "kept", "_key", "list")}
    return added.withColumns(clash).repartition(5, "source").cache()


@pytest.fixture(scope="module")
def rows(odd):
    return [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def one_each(rows):
    return list({r: None for r in rows if r[0] is not None})


def test_components(spark):
    draw = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 300, (170, 2))]
    edges += [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)] + [(2000, 2001 + i) for i in range(50)]
    df = spark.createDataFrame([*edges, (None, 4), (7, None)], "u long, v long")
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == B.classes(nodes, [e for e in edges if e[0] != e[1]])
    assert components.components(df.limit(0)).count() == 0


def test_sharding(odd, rows, empty):
    got = sharding.balanced_shards(odd).collect()
    assert len(got) == len(rows)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    sizes = [len(v) for v in shards.values()]
    assert len(shards) == 8 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    want = Counter((i, len((t or "").encode()) + 1, B.crc(t)) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    text = dict(rows)
    where = defaultdict(set)
    for r in got:
        if r["doc_id"] is not None and text[r["doc_id"]] is not None:
            where[text[r["doc_id"]]].add(r["shard"])
    copies = Counter(t for _, t in rows if t is not None)
    several = [t for t, n in copies.items() if 1 < n]
    assert sum(len(where[t]) > 1 for t in several) <= 0.2 * len(several) + 1
    assert sharding.balanced_shards(empty).count() == 0


def test_sharding_splits_only_what_no_shard_can_hold(spark):
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.balanced_shards(docs).collect()
    assert set(Counter(r["shard"] for r in got).values()) == {150}
    hot = Counter(r["shard"] for r in got if r["doc_id"] % 3 == 0)
    assert len(hot) <= 5 and sum(hot.values()) == 400


def test_nearest(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    odd = [(100000, [0.0] * 64), (100050, None), (100100, [float("nan")] * 64), (100150, [1.0]),
           (100200, [1e30] * 64), (100250, [None] * 64), (None, [1.0] * 64)]
    known = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    more = known.unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<double>"))
    more = more.unionByName(known.limit(3)).withColumn("list", F.lit("clash"))
    want = B.nearest([(r[0], r[1]) for r in known.collect()] + [odd[4]])
    got = defaultdict(list)
    for r in ann.nearest(more).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    exact = {q: dict(v) for q, v in want.items()}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1)) and len(found) == 5
        hits += sum(i in exact[q] for _, i, _ in found)
        assert all(abs(s - exact[q][i]) < 1e-12 for _, i, s in found if i in exact[q])
    assert hits >= 0.9 * 5 * len(want)
    assert ann.nearest(more.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 1.0]), (3, [2.0, 2.0])],
                                "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in sorted(ann.nearest(few).collect(), key=lambda r: r["rank"])] == [3, 7]


def test_urls(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html")
    link = '<link rel="canonical" href="{}">'.format
    move = '<meta http-equiv="refresh" content="0; url={}">'.format
    more = [(-1, None, None), (-2, "no scheme/de/", "x"), (-3, "http://A.Example.ORG/es/1?q#f", ""),
            (-4, "https://m.site.net/a", link("https://shop.com/de/x")), (-5, "https://shop.com/de/x", None),
            (-6, "http://m.site.net/b", move("/c")), (-7, "http://m.site.net/c#top", link("/d/e")),
            (-8, "http://m.site.net/d/e", link("http://q.com/de/z?a=1&amp;b=2")),
            (-9, "http://both.net/1", link("http://both.net/2") + link("http://s.com/de/")),
            (-10, "http://both.net/2", move("http://t.com/fr/")), (-4, "https://m.site.net/a", None),
            (-11, "http://org", None), (-12, "http://", None), (-13, "http://x.org/", link("http://s.com/de/"))]
    table = pages.unionByName(spark.createDataFrame(more, pages.schema)).withColumn("node", F.lit(1))
    got = urls.judge(table, urls.rule_table(spark, queries.RULES)).collect()
    assert len(got) == pages.count() + len(more)
    by_page = {r["page_id"]: r for r in got}
    for page, url in [(r[0], r[1]) for r in table.select("page_id", "url").collect()]:
        r = by_page[page]
        rule, verdict = B.url_rule(url)
        assert (r["host"], r["path"], r["rule"]) == (*B.url_parts(url), rule)
        assert verdict is None or r["verdict"] == verdict
    spread = {-4: "block", -6: "block", -7: "block", -8: "block", -9: "allow", -10: "allow",
              -1: "allow", -2: "allow", -13: "allow"}
    assert {p: by_page[p]["verdict"] for p in spread} == spread
    assert urls.judge(table.limit(0), urls.rule_table(spark, queries.RULES)).count() == 0


def test_near_duplicates(odd, rows, empty):
    got = near.duplicate_classes(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    want = B.near_duplicates(rows)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert near.duplicate_classes(empty).count() == 0


def test_near_duplicates_across_components(spark):
    """Chains of edits: neighbours are alike, the ends are not; no link may be lost."""
    draw = np.random.default_rng(3)
    texts = []
    for group in range(4):
        words = [f"w{group}x{i}" for i in draw.integers(0, 10 ** 6, 120)]
        for step in range(12):
            words = list(words)
            words[(step * 29) % 120] = f"n{group}s{step}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near.duplicate_classes(docs).collect()}
    assert got == B.near_duplicates(list(enumerate(texts)))


def test_near_duplicates_with_repeated_extras(spark):
    """The extra shingles repeat inside the longer text; distinct ones still reach the threshold."""
    docs = []
    for group in range(20):
        shared = [f"g{group}w{i}" for i in range(404)]
        docs.append((2 * group, " ".join(shared)))
        docs.append((2 * group + 1, " ".join(shared + [f"g{group}x{i}" for i in range(96)] * 50)))
    got = {r["doc_id"]: r["class_id"] for r in near.duplicate_classes(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = B.near_duplicates(docs)
    assert set(want.values()) == set(range(0, 40, 2)) and got == want


def test_signature_estimates_probability_jaccard():
    draw = np.random.default_rng(5)
    keys = np.sort(draw.choice(1 << 50, 400, replace=False).astype(np.uint64))
    weight = draw.uniform(0.2, 5, 400)
    other = np.where(draw.random(400) < 0.3, weight * 3, weight)
    want = sum(1 / np.maximum(weight / weight[i], other / other[i]).sum() for i in range(400))
    a, b = (near.signatures(keys, w, 1, 4096) for w in (weight, other))
    assert abs((a == b).mean() - want) < 4 * math.sqrt(want * (1 - want) / 4096)


def test_sentence_spans(spark, odd, rows, empty):
    got = {r["doc_id"]: r for r in spans.remove_repeated(odd).collect()}
    assert len(got) == len({i for i, _ in rows})
    passage = " ".join(f"Sentence number{i} speaks of thing{i} and of matter{i} at length." for i in range(6))
    docs = [(1, f"One two three. {passage} Alone a."), (2, f"Four five.\n{passage}\nOther b c."),
            (3, "Nothing here repeats. At all it does not."), (4, None), (5, " ".join(["same"] * 80)),
            (6, "lead in words " + " ".join(f"t{i}" for i in range(60))),
            (7, "x. " + " ".join(f"t{i}" for i in range(60)))]
    kept = {r["doc_id"]: r["kept"] for r in spans.remove_repeated(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept[1] == docs[0][1] and kept[3] == docs[2][1] and kept[4] is None
    assert kept[2].split() == "Four five. Other b c.".split()
    assert spans.remove_repeated(empty).count() == 0


def test_sentences_cover_the_text():
    text = " A b c! Next one. " + "long " * 70 + "\n\nEnd"
    parts = spans.sentences(text)
    assert "".join(text[a:b] for a, b, _ in parts) == text
    assert max(len(w) for _, _, w in parts) <= spans.WORDS
    for counts in ([30, 25], [10] * 5, [20, 20, 5, 6], [60], [3, 3], []):
        found = spans.runs(counts)
        assert all(j - i >= 2 and sum(counts[i:j]) >= 25 for i, j in found)
        if sum(counts) >= 50 and len(counts) > 1:
            assert set().union(*(range(i, j) for i, j in found)) == set(range(len(counts)))


def test_long_sentences_are_cut_by_their_words(spark):
    passage = " ".join(f"t{i}" for i in range(60))
    docs = [(6, "lead in words " + passage), (7, "x. " + passage),
            (8, " ".join(f"a{i}" for i in range(37)) + f" {passage} " + " ".join(f"b{i}" for i in range(41)))]
    got = {r["doc_id"]: r for r in spans.remove_repeated(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    left = {i: r["kept"].split() for i, r in got.items()}
    assert got[6]["kept"] == docs[0][1]
    assert left[7][0] == "x." and 25 <= 61 - len(left[7]) <= 60
    own = [w for w in docs[2][1].split() if w[0] != "t"]
    assert [w for w in left[8] if w[0] != "t"] == own and len(left[8]) <= 138 - 25


def test_every_shared_passage_of_55_words_is_found():
    draw = np.random.default_rng(8)
    for trial in range(200):
        passage = [f"p{trial}w{i}" for i in range(55)]
        names = []
        for side in "ab":
            before, behind = ([f"{side}{x}{i}" for i in range(draw.integers(0, 60))] for x in "uv")
            parts = [w for _, _, w in spans.sentences(" ".join(before + passage + behind))]
            names.append({tuple(sum(parts[i:j], [])) for i, j in spans.runs([len(w) for w in parts])})
        assert names[0] & names[1], trial


def test_language(odd, rows, empty, spark):
    model = language.train(odd.where(~queries.held_out()))
    got = language.identify(odd.withColumn("held", queries.held_out()), model,
                            keep=["doc_id", "lang", "text", "held"]).collect()
    assert len(got) == len(rows)
    for r in got:
        letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letter) and 0 <= r["score"] <= 1
        assert letter or r["score"] == 0
    hidden = [r["lang_pred"] == r["lang"] for r in got
              if r["held"] and r["lang"] and len(r["text"] or "") > 200]
    assert len(hidden) > 20 and np.mean(hidden) >= 0.95
    assert language.identify(empty, model).count() == 0
    blank = language.train(empty)
    assert {r["lang_pred"] for r in language.identify(odd, blank).collect()} == {"und"}


def test_packing(odd, rows, empty):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    cut = packing.pieces(odd, queries.TOKENIZER, keep_ids=True)
    packed = packing.pack(cut).collect()
    ids = {t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
           for t in {t for _, t in rows}}
    want = Counter()
    for doc, text in rows:
        own, at, piece = ids[text], 0, 0
        while at < len(own):
            stop = at + (len(own) - at - 1) % 1024 + 1
            want[doc, piece, at, stop - at, zlib.crc32(own[at:stop].tobytes())] += 1
            at, piece = stop, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
                   for r in packed) == want
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        assert sum(n for _, n in parts) <= 1024
    total = sum(r["length"] for r in packed)
    assert len(bins) <= -(-total // 1024) + 3
    assert packing.pack(packing.pieces(empty, queries.TOKENIZER)).count() == 0


def test_encoder_joins_across_spaces(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    texts = ["a \u00a0 \u00a0 b", "end. \u00a0 \u00a0 \u00a0 \u00a0 Next one", "\u00a0 \u00a0 x y",
             "a\u00a0 b \u00a0c", "hello <|endoftext|> world", "\u00e0 la \u00e0 \u00e0", "x \n \t \u3000 y", "a  b", " ", ""]
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                         queries.TOKENIZER, keep_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {
        i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}


def test_plan_places_every_length():
    draw = np.random.default_rng(9)
    histogram = {int(n): int(c) for n, c in zip(draw.choice(1024, 200, replace=False) + 1,
                                                draw.integers(1, 5000, 200))}
    runs, load = packing.plan(histogram), Counter()
    ranks = defaultdict(list)
    for length, rank, bins, per, first, offset in runs:
        ranks[length].append((rank, bins * per))
        for b in range(first, first + bins):
            load[b] += per * length
    for length, parts in ranks.items():
        assert [r for r, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        assert sum(n for _, n in parts) == histogram[length]
    assert max(load.values()) <= 1024 and set(load) == set(range(len(load)))


def test_personal_data(odd, rows, empty):
    weights = pii.train(odd)
    got = pii.personal_data(odd, weights).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        if r["doc_id"] is None:
            continue
        base = B.personal(text[r["doc_id"]])
        assert [tuple(s) for s in r["base"]] == base
        assert set(base) <= {tuple(s) for s in r["spans"]}
    added = [text[r["doc_id"]][s["start"]:s["end"]] for r in got if r["doc_id"] is not None
             for s in r["spans"] if s not in r["base"]]
    assert all(sum(c.isdigit() for c in s) >= 10 or "@" in s for s in added)
    assert pii.personal_data(empty, pii.train(empty)).count() == 0


@pytest.mark.parametrize("text", [
    "a@b.c@d.e", "x" * 5000, "1" * 5000, "a@b@c.d", "1.2.3.4.5.6.7.8.9", "0000012.3.4.255",
    "4111-1111 1111 1111 +1 (555) 123-4567.", "@@a@b.", "+1" + " " * 50 + "2", "1.2.3.1000 5.6.7.8",
    "é@b.cc é1.2.3.4 ٣.٣.٣.٣", "5500000000000004 55000000000000045"])
def test_base_spans(text):
    assert pii.base_spans(text) == B.personal(text)


def test_redaction():
    text = "mail me@x.org or +1 (555) 123-4567 now"
    assert pii.redacted(text, pii.base_spans(text)) == "mail [EMAIL] or [PHONE] now"


def test_repeated_bytes(odd, rows, empty):
    got = suffixes.remove_repeats(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    want = B.repeated_bytes(one_each(rows))
    for r in got:
        if r["doc_id"] is not None:
            assert want[r["doc_id"]] == (r["n_bytes"], r["n_removed"], len(r["spans"]),
                                         B.digest(bytes(r["kept"]))), r["doc_id"]
    assert suffixes.remove_repeats(empty).count() == 0


def test_repeated_bytes_in_open_grams(spark, monkeypatch):
    """Common passages in ever new surroundings, with every limit small."""
    for name in ("FEW", "GATHERED"):
        monkeypatch.setattr(suffixes, name, 2)
    draw = np.random.default_rng(12)
    word = lambda n: bytes(draw.integers(97, 123, n, dtype=np.uint8)).decode()
    common = [word(n) for n in (60, 99, 100, 101, 180)]
    docs = [(i, "".join(word(int(draw.integers(0, 90))) + common[k] for k in draw.integers(0, 5, 4)))
            for i in range(60)] + [(60, "ab" * 200), (61, "ab" * 90), (62, "a" * 101)]
    got = suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = B.repeated_bytes(docs)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), B.digest(bytes(r["kept"])))
            for r in got} == want


def test_repeated_bytes_of_a_chunk_with_many_stretches(spark):
    """An earlier level holds the one stretch that a chunk keeps of a gram with over FEW."""
    draw = np.random.default_rng(25)
    word = lambda n: bytes(draw.integers(97, 123, n, dtype=np.uint8)).decode()
    common = word(110)
    texts = [word(100) + common + word(100) for _ in range(100)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    found = suffixes.anchors(suffixes.A.Block(0, data, np.arange(101) * 310))
    grams = defaultdict(dict)
    for gram, stretch, doc in zip(found["gram"], found["stretch"], found["doc"]):
        grams[gram][stretch] = doc
    many = [g for g in grams.values() if len(g) > suffixes.FEW]
    assert len(many) == 1
    kept = texts[many[0][min(many[0])]]
    docs = [(i, kept if i == 10 else word(150)) for i in range(100)]
    docs += [(1000 + i, t) for i, t in enumerate(texts)]
    got = suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1),
                                  batches=2).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), B.digest(bytes(r["kept"])))
            for r in got} == B.repeated_bytes(docs)


def test_contamination(spark, odd, rows, empty):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text")
    more = [(900, "Word"), (901, None), (902, "--"), (None, "alpha beta"), (903, "IOTA, kappa lambda"),
            (904, PLAIN), (900, "tab")]
    table = items.unionByName(spark.createDataFrame(more, items.schema)).withColumn("words", F.lit(0))
    want = B.contamination(rows, [(r[0], r[1]) for r in table.select("item_id", "text").collect()])
    for limit in (1 << 20, 300):
        got = contamination.contaminated(odd, table, limit=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is not None:
                assert want[r["doc_id"]] == (r["n_words"], len(r["hits"]), set(r["items"]))
    assert contamination.contaminated(empty, table).count() == 0
    assert {len(r["hits"]) for r in contamination.contaminated(odd, table.limit(0)).collect()} == {0}


def test_pipeline_stages(spark, odd, rows, empty):
    kept = dict(corpus_pipeline.STAGES)
    names = odd.columns
    text = dict(rows)
    known = kept["language"](spark, odd, SMALL)
    assert known.columns == names
    letters = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    assert Counter(r["doc_id"] for r in known.select("doc_id").collect()) == Counter(i for i, _ in letters)
    single = kept["near-duplicates"](spark, odd, SMALL)
    want = {i for i, c in B.near_duplicates(rows).items() if i == c}
    ids = [r["doc_id"] for r in single.select("doc_id").collect()]
    assert single.columns == names and sorted(i for i in ids if i is not None) == sorted(want)
    clean = kept["decontamination"](spark, odd, SMALL)
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hit = {i for i, (_, n, _) in B.contamination(rows, items).items() if n and i is not None}
    assert clean.columns == names
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {i for i, _ in rows} - hit
    masked = kept["personal data"](spark, odd, SMALL).select("doc_id", "text", "n_chars").collect()
    assert len(masked) == len(rows)
    for r in masked:
        if r["doc_id"] is not None:
            assert r["n_chars"] == len(r["text"] or "") and not B.personal(r["text"])
            if not B.personal(text[r["doc_id"]]):
                assert r["text"] == text[r["doc_id"]]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0, name


def test_pipeline_rows_without_id(spark):
    """What a stage removes goes whether it has an id or not; rows without id are documents of their
    own; of a group the row with the least id stays, one without id only if no other does."""
    kept = dict(corpus_pipeline.STAGES)
    item = next(r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
                if len((r["text"] or "").split()) > 12)
    other, alone = (" ".join(f"{w}{i}" for i in range(60)) for w in ("word", "lone"))
    docs = spark.createDataFrame([(None, item), (None, f"so {item} it is"), (7, item), (8, "free of it"),
                                  (None, "free too"), (3, other), (None, other), (2, other), (None, None),
                                  (5, None), (None, alone), (None, alone)], "doc_id long, text string")
    clean = sorted((str(r["doc_id"]), r["text"]) for r in kept["decontamination"](spark, docs, SMALL).collect()
                   if r["text"] not in (None, other, alone))
    assert clean == [("8", "free of it"), ("None", "free too")]
    single = [(r["doc_id"], r["text"]) for r in kept["near-duplicates"](spark, docs, SMALL).collect()]
    assert [i for i, t in single if t == other] == [2] and [i for i, t in single if t == item] == [7]
    assert [i for i, t in single if t == alone] == [None]
    assert Counter(i for i, t in single if t is None) == {None: 1, 5: 1}
    assert (8, "free of it") in single and (None, "free too") in single


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < out.select("doc_id").distinct().count() <= spark.read.parquet(
        f"{SMALL}/documents.parquet").count()


def test_suffixes_tell_short_fingerprints_apart(spark):
    """Strings that share 32 bytes, and 32 bits of their fingerprint, but not 100 bytes stay."""
    draw = np.random.default_rng(17)
    letters = np.frombuffer(b"abcdefghijklmnop", np.uint8)
    tries = letters[draw.integers(0, 16, 300_000)]
    sums = suffixes.A.Block(0, tries, np.array([0, len(tries)])).prefix(suffixes.A.VALUES[tries])
    grams = suffixes.A.mix((sums[32:] - sums[:-32]) * suffixes.A.powers(suffixes.A.BASE, len(tries) + 1)[:-32])
    least = int(np.argmin(grams))
    found = {}
    for _ in range(6):
        data = letters[draw.integers(0, 16, (40_000, 100))]
        data[:, 34:66] = tries[least:least + 32]
        rows = suffixes.anchors(suffixes.A.Block(0, data.ravel(), np.arange(40_001) * 100))
        common = rows["at"] == 34
        for doc, name in zip(rows["doc"][common], rows["stretch"][common]):
            found.setdefault(int(name) & 0xFFFFFFFF, {})[int(name)] = data[doc].tobytes().decode()
    pairs = [list(v.values()) for v in found.values() if len(v) > 1]
    assert pairs  # 240,000 strings: several collisions of 32 bits
    docs = [(i, t) for i, t in enumerate(t for p in pairs for t in p)]
    got = suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs) and all(r["n_removed"] == 0 for r in got)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("suffix_level")]
    twice = docs + [(1000 + i, "x" * 20 + t) for i, t in docs]
    for batches in (1, 4):
        got = suffixes.remove_repeats(spark.createDataFrame(twice, "doc_id long, text string"),
                                      batches=batches).collect()
        assert {r["doc_id"]: r["n_removed"] for r in got} == {i: 100 * (i >= 1000) for i, _ in twice}


def test_proximity(spark):
    """Words of a window a little nearer or farther than in the item: found within the slop only."""
    filler = lambda n: " ".join(f"f{k}" for k in range(n))
    words = [f"w{k}" for k in range(10)]
    item = " ".join(words)
    docs = [(0, item), (1, f"{filler(5)} {item}"), (2, None), (3, "nothing of it")]
    for gap in range(1, 7):  # the rarest two, w3 and w7, four words apart in the item
        docs.append((10 + gap, " ".join([filler(4), "w3", *["x"] * (gap - 1), "w7", filler(3)])))
    docs += [(30 + k, " ".join(w for w in words if w not in ("w3", "w7"))) for k in range(9)]
    docs.append((None, item))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (6, "of"), (7, None)], "item_id long, text string")
    got = {r["doc_id"]: (r["items"], r["near"]) for r in contamination.contaminated(df, bench, slop=2).collect()}
    assert got[0] == got[1] == ([5], [5]) and got[2] == ([], [])
    assert got[3] == ([6], [6])
    assert {g for g in range(1, 7) if got[10 + g][1]} == {2, 3, 4, 5, 6}
    assert all(got[10 + g][0] == [] for g in range(1, 7)) and all(got[30 + k] == ([], []) for k in range(9))
    plain = contamination.contaminated(df, bench)
    assert plain.columns == ["doc_id", "n_words", "hits", "items"]
