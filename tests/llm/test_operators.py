"""The training-text operators against plain forms of themselves, and on nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronoplate.llm import bpe, common, cotrain, decontaminate, graph, langid, license_scan, minhash, rules, suffix_dedup, url_filter, wordpiece
from chronoplate.llm.suffix_array import suffix_array

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, key STRING, id INT, th STRING, n DOUBLE, v STRING"


def frame(spark, texts, langs=None, ids=None):
    rows = [((ids or range(len(texts)))[i], t, (langs or ["en"] * len(texts))[i], f"s{i % 3}", len(t) if t is not None else None, "x", i, "y", 0.5, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words="the of and to in alpha beta gamma delta epsilon zeta eta theta iota kappa lamda".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", rng.choice("abcdefgh")]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(25)]
    shared = prose(rng, 60)
    out = [None, "", " \n\t ", "a", "One two", base[0], base[0], base[1] + " tail", base[1], base[2] + " " + shared, shared + " " + base[3], "aé" * 150 + "ß", "xy" * 700, "😀 " * 90, *base]
    out += [" ".join(w if rng.random() > 0.03 else "edited" for w in base[5].split()) for _ in range(20)]
    out.append(" ".join([base[7]] * 40))
    return out


def test_suffix_array_is_the_sorted_order():
    rng = random.Random(1)
    for _ in range(800):
        x = [rng.randint(1, rng.randint(1, 5)) for _ in range(rng.randint(0, 30))] * rng.choice([1, 1, 3])
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_wordpiece_counts_equal_a_search(spark, texts):
    rng = random.Random(2)
    for _ in range(60):
        heads = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(5)}
        tails = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(5)}
        auto = wordpiece.Automaton(heads, tails)
        for _ in range(40):
            w = "".join(rng.choices("abc", k=rng.randint(0, 9)))
            assert auto.count(w) == wordpiece.pieces_by_search(w, heads, tails)
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=wordpiece.default_model())
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    heads, tails = {p[1:] for p in pieces if p[0] == "▁"}, {p for p in pieces if "▁" not in p}
    got = wordpiece.token_counts(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        assert (r.n_words, r.n_tokens) == (len(words), sum(wordpiece.pieces_by_search(w, heads, tails) for w in words))


def test_bpe_equals_tiktoken_and_decodes_back(spark, texts):
    enc = bpe.encoding(*bpe.default_ranks())
    more = [*texts, "word " * 40_000, "x" * 70_000 + " y\n" * 3, "<|endoftext|> it's 12ab  \n\n "]
    both = bpe.encode_and_decode(frame(spark, more))
    for r in bpe.decode(bpe.encode(frame(spark, more))).union(both).collect():
        text = more[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode() and bytes(r.packed) == b"".join(i.to_bytes(4, "little") for i in r.ids)
    long = "".join(random.Random(3).choices("ab  \n.'s1é", k=30_000))
    assert [i for p in bpe.parts(long, 500) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(long)


def test_quality_measures_equal_counts(spark, texts):
    for r in rules.features(frame(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        twice = Counter(windows)
        inside = {j for i, w in enumerate(windows) if twice[w] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))


def test_decision_list_finds_a_planted_rule(spark):
    rng = random.Random(4)
    data = [(i, *(rng.random() for _ in rules.MEASURES)) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id INT, " + ", ".join(f"{m} DOUBLE" for m in rules.MEASURES))
    learned = rules.learn(df.selectExpr("*", "symbol_share >= 0.7 as bad", "doc_id % 3 = 0 as held"))
    assert learned and learned[0][0].measure == "symbol_share" and learned[0][0].at_least and abs(learned[0][0].value - 0.7) < 0.06
    assert rules.learn(df.selectExpr("*", "false as bad", "false as held")) == []
    assert df.limit(0).select(rules.verdict([]).alias("x")).count() == 0


def test_decision_list_cuts_few_nonzero_values(spark):
    rng = random.Random(6)
    few = spark.createDataFrame([(i, rng.random() if i % 40 == 0 else 0.0, rng.random()) for i in range(3000)], "doc_id INT, symbol_share DOUBLE, n_words DOUBLE")
    learned = rules.learn(few.selectExpr("*", "symbol_share > 0 as bad", "doc_id % 3 = 0 as held"), measures=("symbol_share", "n_words"))
    assert few.filter(rules.verdict(learned) != (F.col("symbol_share") == 0)).count() == 0


def brute_near(texts, width, percent):
    sets = []
    for t in texts:
        w = minhash.words_lower(t)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            met = len(a & sets[j])
            if a and sets[j] and 100 * met >= percent * (len(a) + len(sets[j]) - met):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("small", [12, 2])
def test_near_duplicates_equal_all_pairs(spark, texts, small, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", small)  # 2: posts of three go through pivots and blocks
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0 if small == 2 else 1000)
    want, sizes = brute_near(texts, 4, 80)
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, texts), width=4).collect()}
    assert [(got[i].component_id, got[i].n_shingles, got[i].kept) for i in range(len(texts))] == [(want[i], sizes[i], want[i] == i) for i in range(len(texts))]


def test_near_duplicates_of_null_keys_and_nothing(spark):
    rows = minhash.near_duplicates(frame(spark, ["a b c d e", "a b c d e", "a b c d e"], ids=[None, 4, 4]), width=4).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (4, 4, True), (4, 4, True)]
    assert minhash.near_duplicates(frame(spark, ["x"]).limit(0)).count() == 0


def test_near_duplicates_unite_the_texts_of_a_key(spark):
    x, y, z = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(3, x), (4, x), (4, y), (9, y), (9, ""), (12, z), (11, z), (11, None), (None, x), (5, "")]
    got = minhash.near_duplicates(frame(spark, [t for _, t in rows], ids=[i for i, _ in rows]), width=4).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (3, 3, True), (4, 3, False), (4, 3, False), (5, 5, True), (9, 3, False), (9, 3, False), (11, 11, True), (11, 11, True), (12, 11, False)]


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.v: r.root for r in graph.components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def brute_repeats(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + least] for b in data for i in range(len(b) - least + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, y in zip(b, gone, strict=True) if not y)))
    return out


@pytest.mark.parametrize(("least", "hot"), [(200, 5000), (60, 5000), (60, 1)])
def test_repeats_equal_all_windows(spark, texts, least, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", 0 if hot == 1 else 1000)
    want = brute_repeats(texts, least)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts), least=least, carry=("lang",)).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) for i in range(len(texts))] == want
    assert got[0].lang == "en"


def test_repeats_of_random_letters(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("ab", k=rng.randint(30, 90))) for _ in range(6)]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(30)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts), least=50, gram=16).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) for i in range(30)] == brute_repeats(texts, 50)
    assert suffix_dedup.remove_repeats(frame(spark, ["x"]).limit(0)).count() == 0


def test_chunks_of_long_texts_keep_matches(monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "CHUNK_BITS", 10)
    monkeypatch.setattr(suffix_dedup, "_CONSTS", [])
    rng = random.Random(6)
    passage = bytes(rng.choices(range(97, 123), k=600))
    data = b"".join([bytes(rng.choices(range(97, 123), k=900)), passage, bytes(rng.choices(range(97, 123), k=1333)), passage])
    doc, p0, n, off, gram, whole = suffix_dedup.regions(np.frombuffer(data, np.uint8), np.array([len(data)]), 200, 32)
    assert int(n.sum()) == len(data) - 199
    at = defaultdict(set)
    for a, b, c, g in zip(p0.tolist(), n.tolist(), off.tolist(), gram.tolist(), strict=True):
        for w in range(a, a + b):
            at[w].add((g, a + c - w))
    assert all(at[900 + i] == at[900 + 600 + 1333 + i] for i in range(401))


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_decontamination_catches_other_numbers_and_names(spark, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    item = "A train leaves the northern station at 9 o'clock and Miller drives 120 km towards the harbour with 45 sacks of grain while Miller waits"
    other = item.replace("9", "7").replace("Miller", "Becker").replace("120", "300").replace("45", "80")
    mixed = item.replace("9", "7").replace("drives", "steers").replace("northern", "rusty").replace("harbour", "pier").replace("sacks", "crates").replace("waits", "sleeps").replace("while", "until").replace("station", "depot")
    docs = [None, "", f"Intro words here. {item}. More.", f"Some text. {other}", mixed, "Nothing of the kind is written in this text at all, it has only plain words.", item.upper()]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words"), (1, item)], "item_id BIGINT, text STRING")
    got = {r.doc_id: r for r in decontaminate.decontaminate(frame(spark, docs), bench).collect()}
    assert [got[i].contaminated for i in range(7)] == [False, False, True, True, False, False, True]
    assert got[2].items == [1] and got[3].items == [1]
    assert decontaminate.decontaminate(frame(spark, docs), bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_judges_each_occurrence(spark):
    item = "A train leaves the station at 5 o'clock and then drives 40 km towards the harbour with grain"
    variants = " ".join(f"Question. {item.replace('5', x).replace('40', y)}." for x, y in (("7", "50"), ("9", "60"), ("11", "70")))
    chance = " ".join(f"Then leaves the station at {i} o'clock and then drives {i + 50} km towards the harbour." for i in range(12, 40))
    slots = "17 23 42 Anna Berta 99 km 12 kg Carla 7 8"
    short = "Lisbon lies in the west"
    longer = item.replace("and then", "and after some more minutes of waiting then").replace("40", "80")
    docs = [
        variants, f"{chance} {item}. {chance}", f"We read: {slots} and so on.", f"They say that {short} of it.", longer, "There are 18 24 43 Dora Emil 98 km 13 kg Frida 9 6 things.", "They say that it lies in the east of Lisbon.",
        item.replace("train leaves", "bus enters").replace("drives", "flies").replace("towards the harbour", "over a hill").replace("at 5", "after 5"),
    ]
    bench = spark.createDataFrame([(1, item), (2, slots), (3, short)], "item_id BIGINT, text STRING")
    got = {r.doc_id: r.items for r in decontaminate.decontaminate(frame(spark, docs), bench).collect()}
    assert [got[i] for i in range(len(docs))] == [[1], [1], [2], [3], [1], [], [], []]


def test_decontamination_needs_slots_one_to_one_and_in_one_place(spark):
    rng = random.Random(15)
    item = "A train leaves the northern station and Miller drives 120 km towards the harbour with 45 sacks of grain while Miller waits for 45 minutes"
    german = "Ein langer Zug verlässt den alten Bahnhof und der Fahrer sieht nach 40 Minuten einen Hafen mit Schiffen, deren Ladung 300 Tonnen wiegt"
    filler = " ".join(prose(rng, 20) for _ in range(150))
    half = len(item.split()) // 2
    docs = [
        item.replace("120", "7").replace("45", "7"),  # two values on one
        item.replace("45 sacks", "80 sacks").replace("45 minutes", "90 minutes").replace("and Miller", "and Becker"),  # one value turned to two
        item.replace("120", "45").replace("45 sacks", "120 sacks").replace("for 45", "for 120"),  # swapped: still one to one
        " ".join(item.split()[:half]) + f" {filler} " + " ".join(item.split()[half:]),
        german.lower(), german.lower().replace("40", "55").replace("300", "80"), f"{filler} {german} {filler}", "Das Haus " + german.replace("40", "6").replace("300", "9"), filler,
    ]
    bench = spark.createDataFrame([(1, item), (2, german)], "item_id BIGINT, text STRING")
    got = {r.doc_id: r.items for r in decontaminate.decontaminate(frame(spark, docs), bench).collect()}
    assert [got[i] for i in range(len(docs))] == [[], [], [1], [], [2], [2], [2], [2], []]


def test_url_rules_and_templates(spark, monkeypatch):
    R = url_filter.Rule
    urls = ["http://A.Example.com/en/71?x", "https://a.example.com/en/8", "x", None, "http://b.net/de/1", "http://example.net/de/81#t", "http://org/es/", "http://borg/es/1", "http://com", "ftp://u@com:8/en/", "http://q.org/es/9"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id INT, url STRING").selectExpr("*", "'h' as host", "'p' as path", "1 as n", "cast(null as string) as html")
    listed = [R("block", "com/en/"), R("allow", "example.com/en/7"), R("allow", "net/de/"), R("block", "example.net/de/8"), R("block", "org/es/")]
    got = {r.page_id: r for r in url_filter.judge(pages, listed).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == [
        ("a.example.com", "/en/71", "example.com/en/7"), ("a.example.com", "/en/8", "com/en/"), ("", "", None), ("", "", None), ("b.net", "/de/1", "net/de/"), ("example.net", "/de/81", "example.net/de/8"),
        ("org", "/es/", "org/es/"), ("borg", "/es/1", None), ("com", "", None), ("u@com:8", "/en/", None), ("q.org", "/es/9", "org/es/"),
    ]
    assert got[0].verdict == "allow" and got[1].verdict == "block" and got[7].verdict == "allow"
    monkeypatch.setattr(url_filter, "LITERAL_RULES", 0)
    other = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, [*listed, R("block", "com/en/")]).collect()}
    assert other == {i: (r.rule, r.verdict) for i, r in got.items()}
    tied = url_filter.judge(pages, [R("allow", "com/en/"), R("block", "com/en/")]).filter("rule = 'com/en/'").select("verdict").distinct().collect()
    assert [r.verdict for r in tied] == ["block"]
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}


def brute_tree(rows, many=20, rare=0.02, similar=2.0, weight=2.0, reject=0.8):
    """(template, purity, verdict) of (host, segments' shapes, bad or None) rows, by plain loops."""
    import math

    def alike(b1, n1, b2, n2):
        p = (b1 + b2 + 0.5) / (n1 + n2 + 1)
        return not n1 or not n2 or abs(b1 / n1 - b2 / n2) <= similar * math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))

    def count(some):
        return sum(r[2] is not None for r in some), sum(bool(r[2]) for r in some)

    done = [[] for _ in rows]
    for level in range(max(len(r[1]) for r in rows)):
        slots = defaultdict(list)
        for i, r in enumerate(rows):
            if len(r[1]) > level:
                slots[r[0], tuple(done[i])].append(i)
        for members in slots.values():
            by = defaultdict(list)
            for i in members:
                by[rows[i][1][level]].append(i)
            lab, bad = count([rows[i] for i in members])
            rate = (bad + 0.5) / (lab + 1)
            kinds = defaultdict(list)
            for x, m in by.items():
                kinds["*" if x.startswith("{") or (len(by) > many and len(m) < rare * len(members)) else f"={x}"] += m
            bins = defaultdict(list)
            for x, m in kinds.items():
                n, b = count([rows[i] for i in m])
                bins[min(15, int(math.asin(math.sqrt((b + weight * rate) / (n + weight))) * 2 / math.pi * 16))].append(x)
            groups, total = [], (0, 0)
            for k in sorted(bins):
                n, b = count([rows[i] for x in bins[k] for i in kinds[x]])
                if groups and alike(total[1], total[0], b, n):
                    groups[-1] += bins[k]
                    total = (total[0] + n, total[1] + b)
                else:
                    groups.append(list(bins[k]))
                    total = (n, b)
            for g in groups:
                name = "*" if "*" in g else min(g)[1:] + ("|…" if len(g) > 1 else "")
                for x in g:
                    for i in kinds[x]:
                        done[i].append(name)
    lab, bad = count(rows)
    forms = ["/".join("*" if s.startswith("{") else s for s in r[1]) for r in rows]
    keys = [[forms[i], (".".join(r[0].split(".")[-2:]), forms[i]), (r[0], "/".join(done[i]))] for i, r in enumerate(rows)]
    sums = defaultdict(lambda: [0, 0])
    for r, ks in zip(rows, keys, strict=True):
        for j, k in enumerate(ks):
            sums[j, k][0] += r[2] is not None
            sums[j, k][1] += bool(r[2])
    out = []
    for r, ks in zip(rows, keys, strict=True):
        p, support = bad / max(lab, 1), 0
        for j, k in enumerate(ks):
            n, b = sums[j, k]
            p, support = (b + weight * p) / (n + weight), support + n
        out.append((ks[2][1], round(p, 9), "block" if p >= reject and support and r[0] else "allow"))
    return out


def test_url_tree_decides_and_equals_plain_loops(spark, monkeypatch):
    rng = random.Random(21)
    junk, clean = "<p>" + "%% ** ## " * 30, "<script>%%%%%%%%%%%%</script><p>" + "plain words of a page " * 20
    rows = [("a.com", f"/spam/{i}/x", junk) for i in range(14)] + [("a.com", f"/spam/{i}/x", None) for i in range(20, 24)] + [("a.com", f"/news/{i}", clean) for i in range(30)]
    rows += [(f"h{i % 3}.net", f"/ads/{i}", junk) for i in range(40)] + [("new.net", "/ads/77", None), ("other.org", "/ads/5", None), ("new.net", "/fine/77", None)]
    rows += [(f"{rng.choice('ab')}.org", f"/{rng.choice('uvwxyz')}/{rng.choice(['', '7', 'q', 'r2'])}", rng.choice([junk, clean, clean, None])) for _ in range(150)]
    rows += [("many.org", f"/{chr(97 + i % 26)}{chr(97 + i // 26)}/z", clean if i % 2 else junk) for i in range(120)] + [("", "", junk)]
    pages = spark.createDataFrame([(i, f"https://{h}{p}" if h else None, html, "c") for i, (h, p, html) in enumerate(rows)], "page_id INT, url STRING, html STRING, at STRING")
    shaped = [(h, ["{number}" if s.isdigit() else "{mixed}" if any(map(str.isdigit, s)) else s for s in p.split("/") if s], None if html is None else html == junk) for h, p, html in rows]
    got = {r.page_id: (r.template, round(r.purity, 9), r.verdict) for r in url_filter.judge(pages, []).collect()}
    assert [got[i] for i in range(len(rows))] == brute_tree(shaped)
    verdicts = {r: got[i][2] for i, r in enumerate(rows) if r[2] is None}
    assert all(verdicts[r] == ("block" if "/spam/" in r[1] or "/ads/" in r[1] else "allow") for r in verdicts if r[0] in ("a.com", "new.net", "other.org"))


def test_language_id_on_held_out_rows(spark):
    rng = random.Random(7)
    vocab = {"de": "und der die das ist nicht schön über für mit", "en": "the and with this that have would there from", "fr": "les des est dans être avec pour très où", "es": "los las que para está niño también muy con"}
    langs = [rng.choice(list(vocab)) for _ in range(240)]
    texts = [prose(rng, 30, vocab[x].split()) for x in langs]
    got = langid.identify(frame(spark, [*texts, None, "12 34 !", ""], [*langs, "en", "de", None])).collect()
    by = {r.doc_id: r for r in got}
    held = [i for i in range(240) if by[i].held_out]
    assert held and sum(by[i].lang_pred == langs[i] for i in held) >= 0.95 * len(held)
    assert [(by[i].lang_pred, by[i].score) for i in (240, 241, 242)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(frame(spark, ["ab cd"], [None])).collect()} == {"und"}
    assert langid.identify(frame(spark, ["x"]).limit(0)).count() == 0


def test_cotraining_learns_from_labels(spark):
    rng = random.Random(8)
    texts = [" ".join(w + "***" for w in prose(rng, 40).split()) if i % 4 == 0 else prose(rng, 60) for i in range(200)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(120)] + [(5, 0, 0), (3, None, 1), (None, 1, 0)], "doc_id BIGINT, quality INT, toxic INT")
    got = {r.doc_id: r for r in cotrain.cotrain(frame(spark, texts), labels).collect()}
    assert len(got) == 202 and sum(got[i].kept == (i % 4 != 0) for i in range(120, 200)) >= 76
    none = cotrain.cotrain(frame(spark, texts[:3]), labels.limit(0)).collect()
    assert len(none) == 3 and all(r.kept and r.score is None for r in none)
    assert cotrain.cotrain(frame(spark, ["x"]).limit(0), labels).count() == 0


def test_language_machines_vote_as_plain_loops(spark):
    import math

    rng = random.Random(17)
    vocab = {"de": "und der die das ist nicht", "nl": "en de het een niet van", "en": "the and with this that", "fr": "les des est dans", "es": "los las que para"}
    rows = [(i, prose(rng, 25, vocab[x].split()), x) for i, x in enumerate(rng.choices(list(vocab), k=300))]
    docs = spark.createDataFrame([*rows, (None, rows[0][1], "es"), (7, rows[7][1], rows[7][2])], "key INT, text STRING, lang STRING")
    machines = langid.learn(docs)

    def grams(text):
        raw = f" {' '.join(re.findall(r'[^\W\d_]+', text.lower()))} ".encode()
        out = Counter()
        for n in langid.GRAMS:
            for i in range(len(raw) - n + 1):
                out[((int.from_bytes(raw[i : i + n], "big") + n) * int(langid._MUL) % 2**64) >> (64 - langid.BITS)] += 1
        size = math.sqrt(sum(v * v for v in out.values()))
        return {k: v / size for k, v in out.items()}

    for _, text, _ in rows[:60]:
        x = grams(text)
        p = [1 / (1 + math.exp(-max(-30, min(30, m.slope * (sum(v * float(m.w[k]) for k, v in x.items()) + m.b) + m.shift)))) for m in machines]
        score, family = max((q, m.side[7:]) for q, m in zip(p, machines, strict=True) if m.side.startswith("family:"))
        votes = defaultdict(list)
        for q, m in zip(p, machines, strict=True):
            if langid.family(m.side) == family:
                votes[m.side].append(q)
                if m.other != m.side:
                    votes[m.other].append(1 - q)
        best = max(sorted(votes), key=lambda v: (sum(q > 0.5 for q in votes[v]), sum(votes[v])))
        ((got, value),) = langid.Judge(machines)([text])
        assert got == best and abs(value - score * min(votes[best])) < 1e-4


def auc(pairs):
    good, bad = ([p for p, y in pairs if y == side] for side in (1, 0))
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_cotraining_keeps_labels_and_improves_a_view(spark):
    """Sixty labels among many rows and a cap of as many still teach; labels know half of the sources, the text view's pseudo-labels the others too."""
    rng = random.Random(12)
    good = [int(rng.random() < 0.5) for _ in range(1500)]
    source = [f"s{rng.randint(*((0, 3) if i < 60 else (0, 7))) * 2 + (g if rng.random() < 0.9 else 1 - g)}" for i, g in enumerate(good)]
    texts = [prose(rng, 40) if g else " ".join(w + "**" * rng.randint(1, 2) for w in prose(rng, 40).split()) for g in good]
    docs = spark.createDataFrame([(i, t, "en", source[i], 200) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    labels = spark.createDataFrame([(i, good[i]) for i in range(60)], "doc_id BIGINT, quality INT")
    run = lambda rounds, most: {r.doc_id: r for r in cotrain.cotrain(docs, labels, rounds=rounds, most_labels=most).collect()}
    alone, taught = run(0, 60), run(2, 50)
    open_ = range(60, 1500)
    assert auc([(taught[i].p_meta, good[i]) for i in open_]) > auc([(alone[i].p_meta, good[i]) for i in open_]) + 0.05
    assert auc([(taught[i].score, good[i]) for i in open_]) > 0.97


def test_license_headers_and_inheritance(spark):
    mit, apache, gpl = (license_scan.TEMPLATES[x][0] for x in ("MIT", "Apache-2.0", "GPL-3.0-only"))
    rows = [
        (1, "r/LICENSE", mit), (2, "r/a/x.py", "code"), (3, "r/a/b/y.py", f"text\n{apache}\nmore"), (4, "r/a/b/COPYING", gpl), (5, "r/a/b/c/z.py", None), (6, "q/z.py", "none"),
        (7, None, mit), (8, "r/a/odd.py", "our license is a secret"), (8, "r/a/odd.py", "our license is a secret"),
    ]
    files = spark.createDataFrame(rows, "key INT, path STRING, text STRING").selectExpr("*", "1 as unit", "2 as dir", "3 as named")
    got = sorted(((r.key, r.license, r.origin, r.origin_dir) for r in license_scan.scan(files).collect()), key=str)
    assert got == [
        (1, "MIT", "file", None), (2, "MIT", "inherited", "r"), (3, "Apache-2.0", "header", None), (4, "GPL-3.0-only", "file", None), (5, "GPL-3.0-only", "inherited", "r/a/b"), (6, None, None, None),
        (7, None, None, None), (8, "MIT", "inherited", "r"), (8, "MIT", "inherited", "r"),
    ]
    assert license_scan.scan(files.limit(0)).count() == 0


NOTICES = {
    "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version.\n//\n// This program is distributed in the hope that it will be useful,\nint x;": "GPL-3.0-or-later",
    "/*\n * This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU General Public License\n * as published by the Free Software Foundation; either version 2\n * of the License, or (at your option) any later version.\n */": "GPL-2.0-or-later",
    "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version.": "LGPL-2.1-or-later",
    "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */": "MPL-2.0",
    "#!/bin/sh\n# SPDX-License-Identifier: MIT\necho": "MIT",
    "/* SPDX-License-Identifier: GPL-2.0+ OR BSD-3-Clause */": "GPL-2.0-or-later OR BSD-3-Clause",
    "// SPDX-License-Identifier: GPL-2.0": "GPL-2.0-only",
    "All text on this page, unless otherwise noted, is licensed under CC BY 4.0.": "CC-BY-4.0",
    "We wrote it in May. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. We like it.": "MIT",
    "This work is licensed under the GNU General Public License,\nversion 3. And more words follow here": "GPL-3.0-only",
    "Copyright 2020 The Authors\n\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0": "Apache-2.0",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain it.\n\n3. Neither the name of the Big Company nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD-3-Clause",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:": "BSD-2-Clause",
    "filler words all along " * 400 + "it is licensed under CC BY-SA 4.0 as they say " + "filler words all along " * 400: "CC-BY-SA-4.0",
    "He has a driving license and a licensed gun, which is odd.": None,
    "": None,
}


def test_license_notices(spark):
    """Wrapped, in comments, by identifier, inside sentences and long lines; as headers of files, and in a licence file."""
    rows = [(i, f"d{i}/{name}", text) for i, text in enumerate(NOTICES) for name in ("x.c", "COPYING")]
    got = license_scan.scan(spark.createDataFrame(rows, "key INT, path STRING, text STRING")).collect()
    assert {(r.key, r.license) for r in got} == set(enumerate(NOTICES.values()))


def test_license_ties_and_hot_directories(spark, monkeypatch):
    templates = {"B": ["licensed under terms one"], "A": ["licensed under terms one"], "C": ["licensed under terms two"]}
    files = spark.createDataFrame([(i, f"d/{i}.c", "no words") for i in range(40)] + [(90, "LICENSE", "licensed under terms one"), (91, "d/LICENSE.txt", "licensed under terms two"), (92, "d/LICENSE", "licensed under terms one")], "key INT, path STRING, text STRING")
    few = {r.key: (r.license, r.origin_dir) for r in license_scan.scan(files, templates=templates).collect()}
    assert few[0] == ("B", "d") and few[90] == ("B", None) and len(few) == 43
    monkeypatch.setattr(license_scan, "looked_up", lambda rows, names, on, spread: common.looked_up(rows, names, on, spread, most=0))
    assert {r.key: (r.license, r.origin_dir) for r in license_scan.scan(files, templates=templates).collect()} == few


LABELS = "doc_id BIGINT, quality INT, toxic INT"


def every_operator(spark, docs):
    """(name, result of the operator over docs) of the operators on documents."""
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 30)], LABELS)
    bench = spark.createDataFrame([(1, "wa5 wa6 wa7 wa8 wa9 wa10 wa11 wa12 wa13"), (2, None)], "item_id BIGINT, text STRING")
    files = docs.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    measured = rules.features(docs)
    learned = rules.learn(rules.labelled(measured, labels), least=2)
    return {
        "op1": wordpiece.token_counts(docs), "op2": cotrain.cotrain(docs, labels, rounds=1), "op3": license_scan.scan(files, key="doc_id"), "op4": decontaminate.decontaminate(docs, bench),
        "op5": measured.select("doc_id", rules.verdict(learned).alias("kept")), "op7": bpe.encode_and_decode(docs), "op8": suffix_dedup.remove_repeats(docs), "op9": minhash.near_duplicates(docs, width=4), "op10": langid.identify(docs),
    }


def test_every_operator_on_an_empty_table(spark):
    for name, df in every_operator(spark, frame(spark, ["x"]).limit(0)).items():
        assert df.count() == 0, name


def test_every_operator_on_nulls_repeats_and_very_long_texts(spark):
    """One row for each row; repeated rows get the same; a text of 120,000 words is taken whole; extra columns with clashing names don't matter."""
    long = " ".join(f"wa{i % 7919}" for i in range(120_000)) + " licensed under CC BY 4.0 " + "xy" * 60_000
    texts = [None, "", " \n", long, "same words in a short text", "same words in a short text", "other text of a few words", "12 34 !", None, "ß é 漢字 😀"]
    ids = [0, 1, 2, 3, 4, 4, None, 6, None, 8]
    clash = {"label": "1", "view": "2", "root": "3", "at": "4", "h": "5", "pos": "6", "anchor": "7", "whole": "8", "unit": "9", "template": "10", "part": "11", "draw": "12", "held": "13"}
    docs = frame(spark, texts, ids=ids).withColumns({k: F.lit(v) for k, v in clash.items()})
    got = {name: df.collect() for name, df in every_operator(spark, docs).items()}
    assert {name: len(rows) for name, rows in got.items()} == dict.fromkeys(got, len(texts))
    assert all(len({str(r) for r in rows if r.doc_id == 4}) == 1 for name, rows in got.items() if name not in ("op2", "op3"))  # these know the rows' sources
    one = lambda name, i: next(r for r in got[name] if r.doc_id == i)
    assert one("op1", 3).n_words == 120_000 + 6 and one("op3", 3).license == "CC-BY-4.0" and one("op4", 3).items == [1] and not one("op4", 4).contaminated
    assert bytes(one("op7", 3).decoded) == long.encode() and one("op8", 3).n_removed > 700_000 and one("op8", 4).n_removed == 0
    assert one("op9", 4).component_id == 4 and {r.component_id for r in got["op9"] if r.doc_id is None} == {None}
    assert [one("op10", i).lang_pred for i in (0, 1, 2, 6)] == ["und"] * 4 and one("op2", 0).score is not None


def test_bpe_of_an_empty_table(spark):
    assert bpe.decode(bpe.encode(frame(spark, ["x"]).limit(0))).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_cotraining_holds_back_within_classes(spark):
    """Eight labels of which two are bad: both classes teach and calibrate; the sole key of a class stands in both parts."""
    rows = spark.createDataFrame([(i, float(i > 1)) for i in range(8)] + [(0, 0.0)], "key BIGINT, label DOUBLE")
    for got, alone in ((rows, False), (rows.filter("key <> 1"), True)):
        dealt, counts = cotrain.dealt(got, 50_000)
        assert counts == {0.0: 2 if alone else 3, 1.0: 6}
        for label in (0.0, 1.0):
            known, held = ({r.key for r in dealt.filter(f"label = {label} and {c}").collect()} for c in ("known", "held"))
            assert known and held and (known == held == {0} if alone and label == 0 else not known & held)
    # A rare class survives sampling, and weighs what it would have weighed.
    many = spark.range(40_000).select(F.col("id").alias("key"), (F.col("id") >= 1_500).cast("double").alias("label"))
    drawn, _ = cotrain.dealt(many, 4_000)
    n, weight = drawn.filter("label = 0").agg(F.count("*"), F.sum("weight")).first()
    assert 900 < n < 1_100 and 135 < weight < 165 and 3_500 < drawn.filter("label = 1").count() < 4_200
    assert cotrain.dealt(many.limit(0), 10)[0].count() == 0


def test_cotraining_calibrates_with_weights_of_zero_or_more(spark):
    """A view that points the wrong way on held-back labels weighs nothing; few labels of both classes give scores; equal rows get equal scores."""
    rng = random.Random(3)
    held = spark.createDataFrame([(rng.gauss(2.0 if i % 2 else -2.0, 1.0), rng.gauss(-1.0 if i % 2 else 1.0, 1.0), float(i % 2), 1.0) for i in range(200)], "a DOUBLE, b DOUBLE, label DOUBLE, weight DOUBLE")
    low, high = (held.limit(1).select(F.lit(x).alias("a"), F.lit(0.0).alias("b")).select(cotrain._weighed(held, "a", "b").alias("o")).first().o for x in (-2.0, 2.0))
    assert low < -1 and high > 1
    against = {held.limit(1).select(F.lit(x).alias("b")).select(cotrain._weighed(held, "b").alias("o")).first().o for x in (-5.0, 5.0)}
    assert len(against) == 1
    texts = [" ".join(w + "***" for w in prose(rng, 40).split()) if i % 4 == 0 else prose(rng, 60) for i in range(60)]
    texts += [texts[1], texts[1]]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(8)], "doc_id BIGINT, quality INT")
    got = {r.doc_id: r for r in cotrain.cotrain(frame(spark, texts), labels, rounds=1).collect()}
    assert len(got) == 62 and all(r.score is not None and 0 <= r.score <= 1 for r in got.values())
    assert len({(r.score, r.kept) for i, r in got.items() if i in (60, 61)}) == 1
    tie = cotrain.cotrain(frame(spark, texts), labels, rounds=0, threshold=got[60].score).filter("score >= 0").count()
    assert tie == 62


def test_language_learning_is_bounded(spark):
    """Beyond `most_languages` languages, those with the most rows are learnt; equal numbers go by name."""
    rng = random.Random(5)
    rows = [(i, prose(rng, 20), x) for i, x in enumerate(["en"] * 8 + ["de"] * 6 + ["xb"] * 4 + ["xa"] * 4 + [f"q{i}" for i in range(30)])]
    machines = langid.learn(spark.createDataFrame(rows, "key INT, text STRING, lang STRING"), most_languages=3)
    assert {x for m in machines for x in (m.side, m.other) if not x.startswith("family:")} <= {"en", "de", "xa", ""}
    assert "xa" in {x for m in machines for x in (m.side, m.other)} and "xb" not in {x for m in machines for x in (m.side, m.other)}
