"""Operators of the corpus subpackage against brute force, exact round trips and SQL."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import arrow_text, chat, decontamination, licences, main_text, near_duplicates, pieces, quality_model, quality_rules, queries, sharding, token_counts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, node long"
ODD = [None, "", " \n\t ", "one", "one two three four", "a" * 3000, "ab " * 40_000, "é ñ ß 日本語 ☃ 😀 " * 30, "x\ny\nx\n\nx", "▁ mark", "<|im_end|>\\|<\\|", "The Same text here, twice over.", "The Same text here, twice over.", "\x00\x01 nul"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, None if i % 3 else "en", "s", None, 0.5, 1, 2) for i, t in enumerate(ODD)]
    rows += [rows[11], (None, "no id at all", "xx", None, 1, None, None, None)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.load(queries.piece_file())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
    theirs = con.sql(queries.ORACLE_SQL[name]).df()
    ours = queries.QUERIES[name](spark, sf_small).toPandas()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    show = lambda d: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in d[columns].itertuples(index=False))
    assert show(ours) == show(theirs)


# --- 1: token counts ------------------------------------------------------


def greedy(word, first, later):
    n, at, known = 0, 0, first
    while at < len(word):
        to = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if to is None:
            return 0
        n, at, known = n + 1, to, later
    return n


def test_longest_match_automaton():
    rng = random.Random(3)
    for _ in range(150):
        spelled = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
        first, later = {spelled() for _ in range(6)}, {spelled() for _ in range(6)} | set(rng.sample("abc", 2))
        automaton = token_counts.LongestMatch(token_counts.WordPieces(tuple(first), tuple(later)))
        for _ in range(40):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            assert automaton.count(word) == greedy(word, first, later), (word, first, later)


def test_token_counts(odd_docs, no_docs, docs):
    vocabulary = token_counts.WordPieces.from_sentencepiece(queries.piece_file())
    first, later = set(vocabulary.first), set(vocabulary.later)
    assert token_counts.token_counts(no_docs, vocabulary).count() == 0
    rows = odd_docs.limit(100).union(docs.limit(60).select(*docs.columns, F.lit(1.0), F.lit(1), F.lit(1)))
    texts = rows.select("doc_id", "text").collect()
    got = Counter(map(tuple, token_counts.token_counts(rows, vocabulary).collect()))
    expected = Counter()
    for doc_id, text in texts:
        own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        counts = [greedy("▁" + w, first, later) if len(w) < 500 else None for w in own]
        counts = [token_counts.LongestMatch(vocabulary).count("▁" + w) if c is None else c for c, w in zip(counts, own)]
        expected[doc_id, len(own), sum(c or 1 for c in counts), sum(c == 0 for c in counts)] += 1
    assert got == expected
    assert token_counts.WordPieces.from_marked(["a", "##b", "##"]) == token_counts.WordPieces(("a",), ("b",))


# --- 2: near-duplicates ---------------------------------------------------


def shingle_counts(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    return len(a.keys() & b.keys()) / len(a.keys() | b.keys())


def brute_classes(rows):
    counted = [(i, shingle_counts(t)) for i, t in rows]
    owners = defaultdict(set)
    for k, (_, c) in enumerate(counted):
        for s in c:
            owners[s].add(k)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen = set()
    for own in owners.values():
        own = sorted(own)
        for a in own:
            for b in own:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    x, y = counted[a][1], counted[b][1]
                    if min(len(x), len(y)) >= 0.4 * max(len(x), len(y)) and similarity(x, y) >= 0.8:
                        parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(counted):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, least.get(find(k))) for k, (i, _) in enumerate(counted))


def near_fixture():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(220)]
    rows = []
    for k in range(60):  # copies of copies: links form a net, not a star
        own = list(base)
        for _ in range(rng.choice((0, 1, 3, 4, 5, 6))):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((k, " ".join(own)))
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for k in range(12):  # neighbours are near, ends are far
        chain[k * 8] = f"new{k}"
        rows.append((100 + k, " ".join(chain)))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [(200 + k, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(40))) for k in range(30)]
    rows += [(300, "Some words, exactly equal but for case."), (301, "some words exactly EQUAL but for case"), (302, None), (303, ""), (304, "!!"), (305, "tiny"), (306, "Tiny!")]
    return rows


def test_near_duplicates_brute_force(spark, docs, no_docs):
    own = near_fixture()
    for rows in (own + own[:5], [tuple(r) for r in docs.select("doc_id", "text").collect()]):
        frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("class_id", F.lit("x"))
        got = near_duplicates.near_duplicate_classes(frame)
        assert Counter(map(tuple, got.collect())) == brute_classes(rows)
    assert near_duplicates.near_duplicate_classes(no_docs).count() == 0


def test_near_duplicates_of_repeated_passages(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        own = [f"p{k}w{rng.randrange(10_000)}" for _ in range(100)]
        line = [f"p{k}l{j}" for j in range(24)]
        rows.append((2 * k, " ".join(own + line * 60)))
        own[30], own[60] = "other", "others"
        rows.append((2 * k + 1, " ".join(own + line)))
    expected = brute_classes(rows)
    assert expected == Counter((i, i - i % 2) for i, _ in rows)
    got = near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == expected


def test_near_duplicates_odd(odd_docs):
    got = dict(tuple(r) for r in near_duplicates.near_duplicate_classes(odd_docs).collect())
    assert got[11] == got[12] == 11 and got[0] == 0 and got[1] == 1 and len(got) == len(ODD) + 1
    kept = near_duplicates.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r[0] for r in kept.select("doc_id").collect())
    assert ids == Counter({i: 1 for i in [*range(len(ODD)), None] if i != 12})


def test_near_duplicates_without_ids(spark):
    """A text that only rows without an id hold is a node like others, also as the hub of its group."""
    rng = random.Random(12)
    base = [f"v{rng.randrange(500)}" for _ in range(120)]
    rows = [(None, " ".join(base)), (None, " ".join(base))]
    for k in range(8):
        rows.append((k, " ".join([*base, *(f"n{k}x{j}" for j in range(12))])))
    rows += [(None, "only ones without an id know these words"), (None, "only ones without an id know these words")]
    got = near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_classes(rows) and brute_classes(rows)[None, 0] == 2


def test_near_duplicates_leave_no_tables(spark, docs):
    from tallyhouse.functions.lasting import file_system, shared_folder

    files, at = file_system(spark, shared_folder(spark))
    before = {f.getPath().getName() for f in files.listStatus(at)}
    assert near_duplicates.near_duplicate_classes(docs).count() == docs.count()
    assert len({f.getPath().getName() for f in files.listStatus(at)} - before) == 1


def test_prob_min_hash_estimates():
    rng = np.random.default_rng(1)
    codes = arrow_text.mix(np.arange(60, dtype=np.uint64))
    wa, wb = rng.integers(1, 6, 40).astype(float), rng.integers(1, 6, 40).astype(float)
    a, b = codes[:40], codes[20:]
    m = 20_000
    found = near_duplicates.prob_min_hash(np.repeat([0, 1], 40), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, m)
    va, vb = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    exact = sum(1 / sum(max(va.get(j, 0) / va[i], vb.get(j, 0) / vb[i]) for j in va.keys() | vb.keys()) for i in va.keys() & vb.keys())
    assert (found[0] == found[1]).mean() == pytest.approx(exact, abs=0.015)


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(25)]
    links = [(a, b) for a, b in links if a != b]
    parent = {x: x for p in links for x in p}
    for _ in range(200):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = near_duplicates.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.comp for r in got.collect()} == parent


# --- 3: decontamination ---------------------------------------------------


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        own = words(t)
        size = min(10, len(own))
        wanted = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if size else set()
        for k in range(len(w) - size + 1):
            if size and tuple(w[k : k + size]) in wanted:
                hit.update(range(k, k + size))
                found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [decontamination.BLOCK_WINDOWS, 2])
def test_contamination(spark, odd_docs, no_docs, block):
    items = [(7, "The same TEXT here, twice"), (10, "a b c d e f g h i j k l m"), (9, None), (8, "..."), (11, "c d e f g h i j k l"), (10, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    extra = spark.createDataFrame([(50, "x A b, c d e f g h i j k l m n", "en", "s", 1, 0.1, 1, 1), (51, "a b c d e f g h i j k l m " * 3, None, None, None, None, None, None)], DOC_SCHEMA)
    rows = odd_docs.union(extra)
    texts = rows.select("doc_id", "text").collect()
    got = decontamination.contamination(rows, benchmark, block_windows=block)
    assert Counter(map(tuple, got.drop("spans").collect())) == Counter((i, *brute_hits(t, items)) for i, t in texts)
    clean = Counter(i for i, t in texts if not brute_hits(t, items)[4])
    kept = decontamination.drop_contaminated(rows, benchmark, block_windows=block)
    assert kept.columns == rows.columns and Counter(r.doc_id for r in kept.collect()) == clean
    cut = decontamination.strip_contaminated(rows, benchmark, block_windows=block).select("doc_id", "text").collect()
    assert len(cut) == len(texts) and dict(cut)[0] is None and dict(cut)[50].split() == ["x", ",", "n"]
    alike = lambda **size: sorted((r.asDict(recursive=True) for r in decontamination.contamination(rows, benchmark, **size).collect()), key=str)
    assert alike(block_windows=block) == alike()
    empty = benchmark.limit(0)
    assert decontamination.contamination(rows, empty, block_windows=block).filter("contaminated").count() == 0
    assert decontamination.contamination(no_docs, benchmark, block_windows=block).count() == 0


@pytest.mark.parametrize("block", [1, 5])
def test_contamination_of_many_blocks(spark, block):
    rng = random.Random(9)
    run = [f"w{k}" for k in range(14)]
    items = [(1, " ".join(run)), (2, "p q r"), (3, "p q r"), (4, " ".join(run[:12]))]
    rows = [(0, "x " + " ".join(run) + " y"), (1, "a p q r p q r b"), (2, " ".join(run[:9])), (3, None), (4, "P, Q! r; " + " ".join(run)), (4, "x"), (None, "p q r")]
    rows += [(10 + k, " ".join(rng.choice(["p", "q", "r", *run]) for _ in range(60))) for k in range(30)]
    docs = spark.createDataFrame([(i, t, 7, "s", [1]) for i, t in rows], "doc_id long, text string, __row long, spans string, items array<int>").repartition(5, F.rand(1))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    with decontamination.Scratch(spark) as scratch:
        assert decontamination._Blocks(benchmark, "item_id", "text", 10, block, scratch).count > 1
    plain = lambda df: sorted((r.asDict(recursive=True) for r in df.collect()), key=str)
    whole = decontamination.contamination(docs, benchmark)
    assert plain(decontamination.contamination(docs, benchmark, block_windows=block)) == plain(whole)
    assert Counter(map(tuple, whole.drop("spans").collect())) == Counter((i, *brute_hits(t, items)) for i, t in rows)
    for operator in (decontamination.drop_contaminated, decontamination.strip_contaminated):
        out = operator(docs, benchmark, block_windows=block)
        assert out.columns == docs.columns and plain(out) == plain(operator(docs, benchmark))
    cut = dict(decontamination.strip_contaminated(docs, benchmark, block_windows=block).filter("doc_id < 4").select("doc_id", "text").collect())
    assert cut[0].split() == ["x", "y"] and cut[1].split() == ["a", "b"] and cut[2] == rows[2][1] and cut[3] is None


def test_window_of_all_items(spark):
    """Items that all share a window aren't broadcast with it; their ids are joined to the hits."""
    items = [(k, "p q r" if k % 3 else f"p q r s{k}") for k in range(300)] + [(None, "p q r"), (None, "u v")]
    rows = [(0, "a p q r b"), (1, "p q r s3 p q r s6 p q r"), (2, "p q"), (3, None), (4, "p q r s9")] + [(k, "x p q r") for k in range(5, 60)] + [(60, "u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (290, 40, 1):  # fewer than the pairs; more than the windows, fewer, one
        with decontamination.Scratch(spark) as scratch:
            blocks = decontamination._Blocks(benchmark, "item_id", "text", 10, block, scratch)
            assert not blocks.whole and blocks.count == -(-102 // block) and all(len(i) == 1 for *_, i in blocks.broadcast(0).value)
        if block == 1:
            break
        got = decontamination.contamination(docs, benchmark, block_windows=block)
        want = Counter((i, *brute_hits(t, [x for x in items if x[0] is not None])) for i, t in rows if i != 60)
        found = {r.doc_id: r for r in got.drop("spans").collect()}
        assert Counter(tuple(r) for r in found.values() if r.doc_id != 60) == want
        assert tuple(found[60])[1:4] == (2, 2, 0) and found[60].contaminated  # an item without an id is hit, but not listed
        assert {r.doc_id for r in decontamination.drop_contaminated(docs, benchmark, block_windows=block).collect()} == {2, 3}


# --- 4: sharding ----------------------------------------------------------


def test_sharding_laws(spark, sf_small, odd_docs, no_docs):
    got = queries.op4_sharding(spark, sf_small).toPandas()
    texts = dict(spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect())
    got = got.sort_values("doc_id")
    total, at, slots = int(got["size"].sum()), 0, Counter()
    for r in got.itertuples():
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes"
        assert r.shard == min(23, (2 * at + r.size) * 24 // (2 * total)) and r.slot == slots[r.shard]
        slots[r.shard] += 1
        at += r.size
    by = got.groupby("shard")["size"].sum()
    assert (by - total / 24).abs().max() <= 2 * got["size"].max()
    sized = odd_docs.withColumn("size", sharding.byte_size("text"))
    out = sharding.shard_by_bytes(sized, 5, "doc_id", "size", partitions=3).toPandas()
    assert len(out) == sized.count() and "node" in out.columns
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    hot = spark.range(1000).select(F.lit(1).alias("doc_id"), F.lit(10).cast("long").alias("size"))
    assert sorted(r["count"] for r in sharding.shard_by_bytes(hot, 4, "doc_id", "size").groupBy("shard").count().collect()) == [250] * 4
    assert sharding.shard_by_bytes(no_docs.withColumn("size", F.lit(1)), 4, "doc_id", "size").count() == 0
    clash = sharding.shard_by_bytes(hot.withColumn("__row", F.lit("mine")), 4, "doc_id", "size")
    assert clash.columns == ["doc_id", "size", "__row", "shard", "slot"] and clash.filter("__row = 'mine'").count() == 1000


# --- 5: quality rules -----------------------------------------------------


def brute_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def brute_script(text):
    """The script of most letters, letter by letter."""
    found = Counter()
    for c in text or "":
        found.update(name for name, own in quality_rules.SCRIPTS.items() if any(low <= ord(c) <= high for low, high in own))
    return max(quality_rules.SCRIPTS, key=lambda name: found[name]) if found else ""


def brute_kept(text, lang, library, bands=quality_rules.BANDS):
    n_words, *_, failed = brute_base(text)
    ids = library.encode(text or "")
    n, pieces_ = max(len(ids), 1), [library.id_to_piece(i) for i in ids]
    shares = np.array(list(Counter(ids).values())) / n
    script = brute_script(text)
    band = bands.get(script, bands.get("", quality_rules.BANDS[""]))
    if lang in bands and lang not in quality_rules.SCRIPTS and script in ("", bands[lang].script or script):
        band = bands[lang]
    x = min(max(np.log2(n), 6), 15)
    entropy = -(shares * np.log2(shares)).sum() - (band.curve[0] + band.curve[1] * x + band.curve[2] * x * x)
    by_byte = sum(library.is_byte(i) and p not in ("<0x0A>", "<0x0D>") for i, p in zip(ids, pieces_)) / n
    values = {"chars_per_token": len(text or "") / n, "tokens_per_word": len(ids) / max(n_words, 1), "byte_share": by_byte, "entropy": entropy}
    return not failed and all(getattr(band, k)[0] <= v <= getattr(band, k)[1] for k, v in values.items())


def test_quality_rules_kept(odd_docs, docs, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_file())
    rows = odd_docs.union(docs.select(*docs.columns, F.lit(1.0), F.lit(1), F.lit(1)))
    for bands in (None, {"en": quality_rules.BANDS["en"]}):  # without a default band too
        got = Counter((r.doc_id, r.kept) for r in quality_rules.quality_rules(rows, model, bands).collect())
        assert got == Counter((r.doc_id, brute_kept(r.text, r.lang, library, bands or quality_rules.BANDS)) for r in rows.collect())
    assert len({k for _, k in got}) == 2


def test_quality_rules(odd_docs, no_docs, docs, model):
    rows = odd_docs.union(docs.select(*docs.columns, F.lit(1.0), F.lit(1), F.lit(1)))
    out = quality_rules.quality_rules(rows, model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = Counter((r.doc_id, *(r[n] for n in names)) for r in out.collect())
    assert got == Counter((r.doc_id, *brute_base(r.text)) for r in rows.collect())
    assert out.filter("kept and base_failed").count() == 0
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_file())
    for r in out.join(docs.select("doc_id", "text"), "doc_id").filter("doc_id >= 20").limit(40).collect():
        ids = library.encode(r.text)
        shares = np.array(list(Counter(ids).values())) / len(ids)
        assert r.n_tokens == len(ids) and r.chars_per_token == pytest.approx(len(r.text) / len(ids)) and r.token_entropy == pytest.approx(-(shares * np.log2(shares)).sum())
    kept = quality_rules.keep_quality(rows, model)
    assert kept.columns == rows.columns and kept.count() == out.filter("kept").count()
    assert quality_rules.quality_rules(no_docs, model).count() == 0


PROSE = {
    "Cyrillic": "Весной река разлилась и затопила нижние луга, поэтому жители деревни переправлялись на лодках. Старый мельник рассказывал детям, как раньше строили плотины и какие рыбы водились в омутах. Зимой дорога замерзала, и в город ездили на санях прямо по льду, потому что так было короче. Однажды учитель нашёл на чердаке старую тетрадь, где его дед записывал погоду, цены на зерно и имена всех проезжих купцов.",
    "Greek": "Την άνοιξη το ποτάμι πλημμύρισε και οι κάτοικοι του χωριού περνούσαν απέναντι με βάρκες. Ο γέρος μυλωνάς διηγόταν στα παιδιά πώς έχτιζαν παλιά τα φράγματα και ποια ψάρια ζούσαν στα βαθιά νερά. Τον χειμώνα ο δρόμος πάγωνε και πήγαιναν στην πόλη από το βουνό. Μια μέρα ο δάσκαλος βρήκε στη σοφίτα ένα παλιό τετράδιο όπου ο παππούς του έγραφε τον καιρό και τις τιμές του σιταριού.",
    "Latin": "Wiosną rzeka wylała i zalała niskie łąki, więc mieszkańcy wsi przeprawiali się łodziami. Stary młynarz opowiadał dzieciom, jak dawniej budowano tamy i jakie ryby żyły w głębokiej wodzie. Zimą droga zamarzała, więc do miasta jeżdżono saniami prosto przez jezioro, bo tak było bliżej. Pewnego dnia nauczyciel znalazł na strychu stary zeszyt, w którym jego dziadek zapisywał pogodę, ceny zboża i nazwiska kupców.",
}


def test_quality_rules_by_script(spark, model):
    """Prose keeps to the band of its script whatever its language is said to be; ciphered prose doesn't."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_file())
    rows = [(script, lang, text) for script, text in PROSE.items() for lang in (None, "xx", script)]
    rows += [("Cyrillic", "en", PROSE["Cyrillic"]), ("Greek", "de", PROSE["Greek"])]
    junk = [("Cyrillic", "ru", "".join(chr(0x400 + (ord(c) * 31 + i * i) % 0x130) if c.isalpha() else c for i, c in enumerate(PROSE["Cyrillic"])))]
    junk += [("Cyrillic", None, " ".join("\u0440" * (3 + i % 4) for i in range(90))), ("Latin", None, " ".join("xq" + "kzvw"[i % 4] * 3 + "jqx" * (i % 3) for i in range(120)))]
    odd = [("", "en", "1 2 3 " * 40), ("", None, None), ("", "en", ""), ("Han", "en", "\u4e2d\u6587 a \U00020000"), ("Latin", "en", "a\u03b1")]
    given = [(k, *row) for k, row in enumerate(rows + junk + odd)]
    docs = spark.createDataFrame(given, "doc_id long, want string, lang string, text string").repartition(3)
    out = {r.doc_id: r for r in quality_rules.quality_rules(docs, model).collect()}
    for k, want, lang, text in given:
        assert out[k].script == want == brute_script(text) and out[k].kept == brute_kept(text, lang, library)
        assert out[k].kept == (k < len(rows))
    kept = quality_rules.keep_quality(docs, model)
    assert {r.doc_id for r in kept.collect()} == set(range(len(rows)))


def test_quality_rules_tell_junk(spark, sf_mid, model):
    docs, labels = (spark.read.parquet(f"{sf_mid}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_rules.quality_rules(docs, model).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, out))
    assert share[1] >= 0.98 and share[0] <= 0.1


# --- 6: chat --------------------------------------------------------------


def test_chat_escapes_and_examples(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", odd, "x"), (1, 1, "assistant", odd, "x"), (1, 2, "user", "a\\|<\\|\\\\n<<||", "x"), (1, 3, "assistant", "\\n<|\\<|", "x"), (2, 0, None, None, "x"), (3, 5, "we\nird\\n", "t", None), (None, 1, "assistant", "late", "x"), (4, 1, "assistant", "b", "x"), (4, 1, "assistant", "b", "x"), (4, 1, "assistant", "a", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, head string")
    formatted = chat.format_turns(frame)
    back = Counter((r.conv_id, r.turn, r.role, r.text) for r in chat.read_turns(formatted).collect())
    assert back == Counter((c, t, r or "", x or "") for c, t, r, x, _ in rows)
    assert formatted.filter("body like '%<|%' or instr(head, '<|') <> 1").count() == 0
    full = defaultdict(str)
    for r in formatted.orderBy("conv_id", "turn", "role", "body").collect():
        full[r.conv_id] += r.head + r.body + r.tail
    spans = {(r.conv_id, r.example): r for r in chat.example_spans(frame).collect()}
    examples = chat.expand_examples(frame).collect()
    assert len(examples) == len(spans) == 6
    for r in examples:
        s = spans[r.conv_id, r.example]
        assert full[r.conv_id][: s.n_chars] == r.context + r.target + r.tail and full[r.conv_id][s.loss_start : s.loss_end] == r.target
    digest = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert digest[1].loss_sha256 == hashlib.sha256((odd + rows[3][3]).encode()).hexdigest() and digest[1].loss_chars == len(odd + rows[3][3])
    assert all(digest[c].formatted_chars == len(t) for c, t in full.items()) and digest[4].n_turns == 3
    assert chat.digests(chat.format_turns(frame.limit(0))).count() == 0


def test_chat_examples_read_back(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"<|t{k}\\") for k in range(1400)]
    rows += [(2, 0, "assistant", t) for t in ("<|", "<a", "\\", "]")] + [(None, 1, "assistant", "x"), (3, 0, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = {(r.conv_id, r.example): r for r in chat.expand_examples(frame).collect()}
    assert len(examples) == 705
    escaped = [t.replace("\\", "\\\\").replace("<|", "<\\|") for _, _, _, t in rows[:1400]]
    full = "".join(f"<|im_start|>{r[2]}\n{t}<|im_end|>\n" for r, t in zip(rows, escaped))
    for r in chat.example_spans(frame).filter("conv_id = 1").collect():
        e = examples[1, r.example]
        assert full[: r.n_chars] == e.context + e.target + e.tail and full[r.loss_start : r.loss_end] == e.target == escaped[2 * r.example + 1]
    # ties are in the order of the texts, as digests has it, not of their escaped forms
    assert Counter(map(tuple, chat.example_digests(frame).collect())) == Counter(map(tuple, chat.digests(chat.format_turns(frame)).collect()))


# --- 7: quality model -----------------------------------------------------


def test_quality_model_held_out(spark, sf_mid, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"{sf_mid}/{t}.parquet") for t in ("documents", "labels"))
    machine = quality_model.fit(docs, labels)
    out = quality_model.score(docs, machine).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(out) > 40 and ((out.score >= 0.3) == (out.quality == 1)).mean() >= 0.95
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id)
    odd = quality_model.score(odd_docs, machine)
    assert odd.count() == odd_docs.count() and odd.filter("score between 0 and 1").count() == odd_docs.count()
    assert quality_model.score(no_docs, machine).count() == 0
    kept = quality_model.keep_predicted(odd_docs, machine)
    assert kept.columns == odd_docs.columns and kept.count() == odd.filter("predicted = 1").count()
    assert quality_model.score(docs, quality_model.fit(docs, labels.limit(0))).count() == docs.count()


def test_scores_by_all_pairs(odd_docs, docs, spark, sf_small):
    machine = quality_model.fit(docs, spark.read.parquet(f"{sf_small}/labels.parquet"))
    rows = odd_docs.union(docs.limit(30).select(*docs.columns, F.lit(1.0), F.lit(1), F.lit(1)))
    k, expected = len(quality_model.STATISTICS), []
    for doc_id, text in rows.select("doc_id", "text").collect():
        raw = (text or "").encode()
        stats, values, buckets, _ = quality_model.features(arrow_text.Chunk(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        own = re.findall(rb"[^\x20\x09-\x0D]+", raw.translate(bytes(range(65)) + b"abcdefghijklmnopqrstuvwxyz" + bytes(range(91, 256))))
        hashed = arrow_text.words(arrow_text.Chunk(np.frombuffer(b" ".join(own), np.uint8), np.array([0, len(b" ".join(own))])), arrow_text.SPACED, True).hashes >> np.uint64(64 - quality_model.BUCKET_BITS)
        assert dict(zip(buckets.tolist(), values.tolist())) == pytest.approx({int(b): c / len(own) for b, c in Counter(hashed.tolist()).items()})
        x, at = np.concatenate([stats[0], values]).astype(float), np.concatenate([np.arange(k), buckets + k])
        v = machine.factors[at].astype(float) * x[:, None]
        z = (machine.linear[at] * x).sum() + (np.triu(v @ v.T, 1)).sum()
        expected.append((doc_id if doc_id is not None else -1, 1 / (1 + np.exp(-np.clip(z, -30, 30)))))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in quality_model.score(rows, machine).collect())
    assert [i for i, _ in got] == [i for i, _ in sorted(expected)] and [x for _, x in got] == pytest.approx([x for _, x in sorted(expected)], abs=1e-4)


def test_machine_interactions_identity():
    rng = np.random.default_rng(0)
    k = len(quality_model.STATISTICS)
    machine = quality_model.FactorisationMachine(rng.normal(0, 0.1, k + (1 << quality_model.BUCKET_BITS)), rng.normal(0, 0.1, (k + (1 << quality_model.BUCKET_BITS), quality_model.RANK)))
    stats, values, buckets = rng.random((1, k)), rng.random(9), rng.integers(0, 1 << quality_model.BUCKET_BITS, 9)
    x, at = np.concatenate([stats[0], values]), np.concatenate([np.arange(k), buckets + k])
    z = (machine.linear[at] * x).sum() + sum(machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert machine.scores(stats, values, buckets, np.array([0, 9]))[0] == pytest.approx(1 / (1 + np.exp(-z)))


# --- 8: pieces ------------------------------------------------------------


def test_pieces_equal_the_library(odd_docs, no_docs, docs, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_file())
    rows = odd_docs.union(docs.limit(80).select(*docs.columns, F.lit(1.0), F.lit(1), F.lit(1)))
    encoded = pieces.encode(rows, model)
    got = Counter((r.doc_id, tuple(r.ids), r.round_trip) for r in encoded.collect())
    assert got == Counter((r.doc_id, tuple(library.encode(r.text or "")), "▁" not in (r.text or "")) for r in rows.collect())
    back = {(r.doc_id, r.text) for r in pieces.decode(encoded, model).collect()}
    assert back == {(r.doc_id, (r.text or "").replace("▁", " ")) for r in rows.collect()}
    assert pieces.encode(no_docs, model).count() == 0


def test_pieces_of_long_texts_without_spaces(spark, model, monkeypatch):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_file())
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh漢字かな0123,.") for _ in range(120_000)), "ab" * 3000, "", "x"]
    monkeypatch.setattr(pieces, "INDEX_CHARS", 1000)
    encoder = pieces.PieceEncoder(model)
    sizes, cut = [], encoder._encode_cut
    monkeypatch.setattr(encoder, "_encode_cut", lambda segments: sizes.append((sum(map(len, segments)), len(segments))) or cut(segments))
    ids, bounds = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t) for t in texts]
    assert len(sizes) > 50 and all(n <= 1000 or k == 1 for n, k in sizes)


def test_unigram_relaxation_is_best_path():
    rng = random.Random(4)
    for case in range(15):
        spelled = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(12)} | {"a", "b", "▁"}
        vocabulary = ["<unk>", *sorted(spelled)]
        scores = [0.0] + [-rng.random() * 9 - 0.1 for _ in vocabulary[1:]]
        m = pieces.PieceModel(tuple(vocabulary), tuple(scores), (False, *(True,) * (len(vocabulary) - 1)), (-1,) * 256, 0, "unigram")
        encoder = pieces.PieceEncoder(m)
        texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 14))) for _ in range(20)]
        ids, bounds = encoder.encode(texts)
        for k, t in enumerate(texts):
            marked = ("▁" + t.replace(" ", "▁"))
            best = [0.0] + [-1e9] * len(marked)
            for e in range(1, len(marked) + 1):
                best[e] = max(best[s] + scores[vocabulary.index(marked[s:e])] for s in range(max(0, e - 4), e) if marked[s:e] in spelled) if any(marked[s:e] in spelled for s in range(max(0, e - 4), e)) else -1e9
            own = ids[bounds[k] : bounds[k + 1]]
            assert "".join(vocabulary[i] for i in own) == marked and sum(scores[i] for i in own) == pytest.approx(best[-1])


# --- 9: licences ----------------------------------------------------------


def test_licences(spark, no_docs):
    mit = licences.TEXTS["MIT"][0]
    changed = mit.upper().replace("COPYRIGHT (C) <YEAR> <COPYRIGHT HOLDERS>", "Copyright © 2031 Someone").replace(",", " ").replace("sublicense", "sublicence")
    rows = [(1, mit), (2, changed), (3, mit.replace("free of charge", "for money")), (4, None), (5, "... !!"), (6, "Text.\nreleased UNDER the mit licence\nmore\nLicensed under CC BY-NC 4.0."), (6, "Text.\nreleased UNDER the mit licence\nmore\nLicensed under CC BY-NC 4.0."), (7, "Released under the MIT License. And more.")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = [(r.doc_id, r.license, r.n_notices, r.notices, r.text_digest is None) for r in licences.scan_licenses(frame).orderBy("doc_id").collect()]
    assert got == [(1, "MIT", 0, "", False), (2, "MIT", 0, "", False), (3, None, 0, "", False), (4, None, 0, "", True), (5, None, 0, "", True), *[(6, None, 2, "CC-BY-NC-4.0,MIT", False)] * 2, (7, None, 0, "", False)]
    assert licences.scan_licenses(no_docs).count() == 0


def test_notices_of_any_words(spark):
    rows = [(1, "Released under the GPL\nx"), (2, "x\nDas gehört allen.\nDAS GEHÖRT  allen"), (3, "the gpl"), (4, "Some organization, favoured"), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    notices = {"GPL": ["Released under the GPL"], "PD": ["Das gehört allen"], "X": ["some organisation favoured", "..."]}
    got = {r.doc_id: (r.n_notices, r.notices) for r in licences.scan_licenses(frame, notices=notices).collect()}
    assert got == {1: (1, "GPL"), 2: (2, "PD"), 3: (0, ""), 4: (1, "X"), 5: (0, "")}
    assert {r.n_notices for r in licences.scan_licenses(frame, notices={}).collect()} == {0}


def test_long_licences_are_known(spark):
    wanted = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "Unlicense"]
    texts = [(n, licences.TEXTS[n][0]) for n in wanted]
    assert all(len(t) > 1_000 for _, t in texts)
    rows = [(n, t) for n, t in texts] + [(n, t.upper()) for n, t in texts] + [("Apache-2.0", texts[0][1].split("APPENDIX")[0])]
    got = licences.scan_licenses(spark.createDataFrame([*rows, (None, texts[1][1][:9000])], "doc_id string, text string")).collect()
    assert len(got) == 20 and all(r.license == r.doc_id for r in got)


# --- 10: main text --------------------------------------------------------


def test_main_text_of_pages(spark, sf_small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()}
    for r in queries.op10_main_text(spark, sf_small).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", s)).split()) for s in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_main_text_by_hand(spark):
    cases = {
        '<html><body><header><h1>Site</h1></header><div class="sidebar">A sidebar, with text. Quite long, really.</div><div id="content"><h2>Title</h2><p>Some text, with punctuation. And more of it.</p><p>Short.</p><ul><li>one</li><li>two &lt;b&gt;</li></ul></div><div class="comments"><p>First comment, nice. Very long indeed.</p></div><footer>c</footer></body></html>': "Title\nSome text, with punctuation. And more of it.\nShort.\none\ntwo <b>",
        "<p>only para": "only para",
        "plain text &amp; more": "plain text & more",
        "<body><p>a</p><p>b": "a\nb",
        "<!-- x": "",
        "<div><article><header><h1>T</h1></header>x<script>var a='<p>'</script> y<br>z</article></div>": "T\nx\ny z",
        "<main><p>x</p><aside>no</aside><form>no<input></form></main><div class='cookie-notice'>We use cookies.</div>": "x",
        None: "",
        "": "",
        "<p>" * 2000 + "deep": "deep",
    }
    frame = spark.createDataFrame([(k, None, h, "x") for k, h in enumerate(cases)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in main_text.extract_main_text(frame).collect()}
    assert got == dict(enumerate(cases.values()))
    assert main_text.extract_main_text(frame.limit(0)).count() == 0


def test_main_text_of_suspicious_names():
    prose = "A paragraph of the text, with some clauses, and full stops. It goes on for a while, as prose does."
    share = '<div class="share"><a href="#">Share</a> <a href="#">Tweet</a></div>'
    cases = {
        f'<article><h2 id="related-work">Related work</h2><p>{prose}</p><section id="copyright"><p>{prose}</p></section><p class="notice">Note that this holds, too.</p>{share}</article>': f"Related work\n{prose}\n{prose}\nNote that this holds, too.",
        f'<body><div class="entry no-sidebar"><p>{prose}</p><p>{prose}</p></div><div class="sidebar">Side, text.</div></body>': f"{prose}\n{prose}",
        f'<body><div class="widget"><h3 class="banner">Title</h3><p>{prose}</p><div class="comments"><p>Nice, very nice.</p></div></div></body>': f"Title\n{prose}",
        f"<article><p>{prose} <math><msup><mi>x</mi><mn>2</mn></msup></math> ends.</p><svg><title>t</title><text>Label one</text></svg></article>": f"{prose} x2 ends.\nLabel one",
        f'<main><p>{prose}</p><div id="comments"><p>First, nice.</p></div></main>': prose,
    }
    assert [main_text.main_text(page) for page in cases] == list(cases.values())


def brute_main_text(page, threshold):
    """The same by nested tag paths as tuples, every sum taken anew; for pages of plain elements."""
    open_, leaves, block = [], [], 0  # elements: (label, tag, factor, boilerplate, number)
    for k, part in enumerate(re.split(r"(<[^>]*>)", page)):
        if not part.startswith("<"):
            if part and not any(e[3] for e in open_):
                leaves.append((tuple(e for e in open_ if e[1] not in main_text._INLINE), block, part, any(e[1] == "a" for e in open_)))
            continue
        tag = re.match(r"</?([a-z0-9]+)", part)
        if not tag or tag[1] in ("br", "meta"):
            if tag and tag[1] == "br" and leaves:
                leaves.append((tuple(e for e in open_ if e[1] not in main_text._INLINE), block, " ", False))
            continue
        tag = tag[1]
        block += tag not in main_text._INLINE
        if part[1] == "/":
            if any(e[1] == tag for e in open_):
                while open_.pop()[1] != tag:
                    pass
            continue
        if tag in main_text._CLOSES_P and any(e[1] == "p" for e in open_):
            while open_.pop()[1] != "p":
                pass
        names = re.findall(r'(?:class|id)="([^"]*)"', part)
        words, inside = set(re.split(r"[^a-z]+", " ".join(names))), any(e[1] in ("article", "main") for e in open_)
        factor = 1.0 if tag in main_text._UNNAMED else 0.05 if words & main_text._STRANGE else (0.5 if inside else 0.2) if words & main_text._DOUBTFUL else 1.0
        open_.append((" ".join([tag, *names]), tag, factor, tag in main_text._BOILERPLATE or tag in ("script", "style", "title"), k))
    units = []  # [elements, block, raw, length in links, length]
    for elements, block, raw, link in leaves:
        if not units or units[-1][1] != block:
            units.append([elements, block, "", 0, 0])
        units[-1][2] += raw
        units[-1][3] += len(raw.strip()) if link else 0
        units[-1][4] += len(raw.strip())
    shown = lambda raw: " ".join(html.unescape(raw).split())
    units = [u for u in units if shown(u[2])]
    path = lambda elements: tuple(e[0] for e in elements)
    tag_of = lambda p: p[-1].split(" ")[0] if p else ""
    names = {path(u[0][:n]) for u in units for n in range(len(u[0]) + 1)}
    of = {p: [u for u in units if path(u[0]) == p] for p in names}
    factor = {path(u[0][:n]): float(np.prod([e[2] for e in u[0][:n]])) for u in units for n in range(len(u[0]) + 1)}
    chars = {p: sum(len(shown(u[2])) for u in us) for p, us in of.items()}
    link = {p: sum(len(shown(u[2])) * u[3] / u[4] for u in us) * (0.5 if tag_of(p) in main_text._HEADINGS else 1.0) for p, us in of.items()}
    points = {p: sum(len(main_text._PUNCTUATION.findall(shown(u[2]))) for u in us) for p, us in of.items()}
    ratio = {p: np.log1p(chars[p] / len(us)) * (1 + np.log1p(min(points[p] / len(us), main_text.MOST_POINTS))) * (1 - link[p] / chars[p]) for p, us in of.items() if us}
    fused = defaultdict(list)
    for i, u in enumerate(units):
        weights = {i: 1.0}
        for j in range(max(0, i - main_text.WINDOW), min(len(units), i + main_text.WINDOW + 1)):
            if j != i:
                shared = next((n for n, (a, b) in enumerate(zip(u[0], units[j][0])) if a != b), min(len(u[0]), len(units[j][0])))
                weights[j] = np.exp(-0.5 * (i - j) ** 2) * 0.5 ** max(0, len(u[0]) + len(units[j][0]) - 2 * shared - 2)
        smooth = sum(w * ratio[path(units[j][0])] for j, w in weights.items()) / sum(weights.values())
        fused[path(u[0])].append(np.sqrt(ratio[path(u[0])] * smooth))
    under = lambda p: [q for q in names if q[: len(p)] == p]
    mass = lambda p: sum((chars[q] - link[q]) * factor[q] for q in under(p)) * (4.0 if tag_of(p) in ("article", "main") else 1.0)
    beside, at = {}, ()
    while tag_of(at) != "article":
        children = [p for p in names if p[:-1] == at and len(p) == len(at) + 1]
        held = [p for p in children if (tag_of(p) not in main_text._OF_TEXT and sum(len(of[q]) for q in under(p)) > max(1, len(of[p]))) or tag_of(p) in ("article", "main")]
        own = (chars[at] - link[at]) * factor[at]
        best = max(held, key=mass, default=None)
        if best is None or mass(best) <= 0 or mass(best) < 0.5 * (own + sum(map(mass, children))):
            break
        beside |= {p: min(1.0, np.sqrt(mass(p) / mass(best))) for p in children if p != best and tag_of(p) not in main_text._HEADINGS}
        beside[at, "own"] = min(1.0, np.sqrt(own / mass(best)))
        at = best
    score = {p: np.mean(fused[p]) * factor[p] * np.prod([beside.get(p[:n], 1.0) for n in range(len(p) + 1)]) * beside.get((p, "own"), 1.0) for p in ratio}
    kept = [shown(u[2]) for u in units if score[path(u[0])] >= threshold * max(score.values())]
    return "\n".join(kept)


def test_main_text_brute_force(spark, sf_small):
    pages = [r.html for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()]
    plain = [re.sub(r"<!--.*?-->|<!DOCTYPE[^>]*>|(?<=<script>)[^<]*(?:<(?!/script)[^<]*)*", "", p) for p in pages[:60]]
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["word", "one,", "two.", "a", "longer", "&amp;"]) for _ in range(rng.choice((1, 3, 10, 40))))

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice((text(), f"<p>{text()}</p>", f"<h2>{text()}</h2>", f"<p>{text()} <a>{text()}</a></p>", f"<ul><li><a>{text()}</a></li><li>{text()}</li></ul>", f"{text()}<br>{text()}"))
        name = rng.choice(("", "", ' class="ad"', ' id="x"', ' class="sidebar b"', ' class="related"'))
        tag = rng.choice(("div", "div", "section", "article", "main", "footer"))
        return f"<{tag}{name}>" + "".join(part(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    plain += ["<body>" + "".join(part(3) for _ in range(3)) + "</body>" for _ in range(150)]
    differ = 0
    for threshold in (0.05, main_text.THRESHOLD, 0.5):
        got = [main_text.main_text(p, threshold) for p in plain]
        assert got == [brute_main_text(p, threshold) for p in plain]
        differ += len(set(got))
    assert len({tuple(main_text.main_text(p, t) for p in plain) for t in (0.0, 0.05, 0.5, 0.95)}) == 4


def test_main_text_without_article(spark, sf_small):
    """The ratios alone find the text where nothing names it."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()}
    named = {r.page_id: r.text for r in queries.op10_main_text(spark, sf_small).collect()}
    for k, page in pages.items():
        assert main_text.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>")) == named[k]


def test_main_text_loses_nothing_of_an_article():
    prose = "A paragraph of the text, with some clauses, and full stops. It goes on for a while, as prose does."
    cases = {
        f'<article><p>{prose}</p><p class="legal">{prose}</p><p class="social-history">Short one.</p><p id="search-theory">{prose}</p><div class="related-work"><p>{prose}</p></div></article>': [prose, prose, "Short one.", prose, prose],
        f'<article><p>{prose}</p><svg width="3"/><p>{prose}</p><p><math><mi>x</mi></math> is.</p><object>Fallback text here.</object></article>': [prose, prose, "x is.", "Fallback text here."],
        f"<article><section><h2>A</h2><p>{prose}</p></section><section><h2>B</h2><p>{prose}</p><p>{prose}</p></section></article>": ["A", prose, "B", prose, prose],
        f'<body><div id="page"><div class="sidebar"><p>{prose}</p></div><div><p>{prose}</p><p>{prose}</p><blockquote>Quote.</blockquote><pre>x = 1</pre><ul><li>apples and pears</li><li>bread</li></ul></div></div></body>': [prose, prose, "Quote.", "x = 1", "apples and pears", "bread"],
        f'<article><h1>T</h1><p>{prose}</p><div class="ad">Buy now, cheap things.</div><p>{prose}</p></article>': ["T", prose, prose],
    }
    assert [main_text.main_text(page).split("\n") for page in cases] == list(cases.values())


def test_main_text_takes_linear_time():
    import time

    for page in (lambda n: "<div>" * n + "deep text", lambda n: "<div><p>word one, two" * n, lambda n: "<p>word, and more.</p>" * n, lambda n: "<ul>" + "<div>" * n + "<li>x</li>" * n, lambda n: "<p>x</p>" + "<a <!" * n):
        took = []
        for n in (4_000, 16_000):
            at = time.process_time()
            main_text.main_text(page(n))
            took.append(time.process_time() - at)
        assert took[1] < 12 * max(took[0], 0.02)


# --- pipeline -------------------------------------------------------------


def test_pipeline_stages(spark, sf_mid, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    columns, left = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_mid).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        left.append(docs.count())
        assert k == 4 or docs.columns == columns
    assert left[0] > left[1] > left[2] > left[3] > left[4] == left[5] > 0 and docs.filter("not round_trip").count() == 0


def test_pipeline_brute_force(spark, sf_small):
    import sentencepiece

    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    machine = quality_model.fit(docs, spark.read.parquet(f"{sf_small}/labels.parquet"))
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_file())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    rows = []
    for r in docs.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        if machine.scores(*quality_model.features(arrow_text.Chunk(raw, np.array([0, len(raw)]))))[0] >= 0.3 and brute_kept(r.text, r.lang, library):
            rows.append((r.doc_id, r.text))
    gone = {i for (i, c), _ in brute_classes(rows).items() if i != c}
    kept = [(i, t) for i, t in rows if i not in gone and not brute_hits(t, items)[4]]
    expected = {i: library.encode(t) for i, t in kept}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf_small).collect()}
    assert got == expected and 0 < len(got) < len(rows) < docs.count()


def test_pipeline_stages_on_odd_tables(spark, sf_small, odd_docs):
    """Nulls, odd and repeated texts, an empty table and columns named like the operators' own: no stage fails,
    the filters keep whole rows, encoding gives a row for each."""
    import corpus_pipeline

    own = odd_docs.withColumns({"k1": F.lit("mine"), "node": F.lit(1), "ids": F.lit("x"), "__row": F.lit(2), "spans": F.lit(None).cast("string"), "size": F.lit(0)})
    for docs in (own, own.limit(0)):
        known = Counter(map(str, docs.collect()))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_small)
            if k == 4:
                assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in docs.select("doc_id").collect())
            else:
                assert out.columns == docs.columns and not Counter(map(str, out.collect())) - known
