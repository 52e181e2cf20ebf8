import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import leaks as lk
from skyloom.llm.leaks import Items, _prepared, leaked_items, search_pages, without_first_sentence
from skyloom.llm.letters import reading_order, to_letters
from skyloom.llm.packing import _packed, best_fit_decreasing, bound_sums, lower_bound, pack, packing_certificates, packing_checks, packing_report, token_counts
from skyloom.llm.stuffing import flagged, page_curves, stuffed_pages
from skyloom.llm.wordstream import ADDRESS, NUMBER, TAG, to_words
from skyloom.llm.wumanber import WINDOW, WuManber

WORDS = "tenant harbour weaver signal crossed before gentle market quiet lantern ferry copper bridge orchard window planted thunder clever journey captain barrel meadow".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def page(text, width=40):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) + 1 > width:
            lines.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join([*lines, line])


DOCS = "doc_id long, text string, lang string, line_boxes array<struct<x:int,y:int,w:int,h:int,conf:float>>, item_id string, boxes int, words int"


def documents(spark, rows):
    """rows: (id, text) or (id, text, boxes)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else None, "x", 1, 2) for r in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, doc_id int")


def leaks(spark, docs, its):
    return sorted(tuple(r)[:2] for r in leaked_items(documents(spark, docs), items(spark, its)).collect())


def sentence(seed, n=30):
    rng = random.Random(seed)
    return [f"{rng.choice(WORDS)}{rng.choice(['ing', 'ed', 's', 'ish', 'ley', 'ton', 'worth'])}" for _ in range(n)]


ITEM = sentence(1)
TEXT = " ".join(ITEM)


def around(middle, seed=3):
    rng = random.Random(seed)
    return page(f"{prose(rng, 30)} {middle} {prose(rng, 30)}")


@pytest.mark.parametrize("n, found", [(13, False), (14, False), (15, True), (16, True), (30, True)])
def test_length_of_the_passage(spark, n, found):
    assert leaks(spark, [(7, around(" ".join(ITEM[5 : 5 + n])))], [(9, TEXT)]) == ([(7, 9)] if found else [])


def test_damaged_passages(spark):
    quote = " ".join(ITEM[2:24])
    swap = str.maketrans({"e": "c", "n": "u"})
    broken = page(quote, 23).split("\n")
    advert = "\n".join([*broken[:3], "CHEAP BOOTS, 3s. AT HOLM'S", "* * *", *broken[3:]])
    rng = random.Random(0)
    lost = "".join(c for c in quote if rng.random() > 0.015)
    shuffled = " ".join(w for k in (2, 0, 3, 1) for w in ITEM[k * 6 : k * 6 + 6])
    hyphens = "-\n".join(quote[i : i + 31] for i in range(0, len(quote), 31))
    docs = [(1, quote.upper()), (2, quote.translate(swap)), (3, hyphens), (4, quote.replace(" ", "")), (5, advert), (6, around(lost)), (7, around(shuffled)), (8, None), (9, ""), (10, " \n\n "), (None, quote), (1, quote), (11, around(prose(random.Random(8), 40)))]
    found = leaked_items(documents(spark, docs), items(spark, [(5, TEXT)]))
    assert Counter(r["doc_id"] for r in found.collect()) == Counter([1, 1, 2, 3, 4, 5, 6, None])


def test_replaced_words_break_a_passage(spark):
    words = ITEM[:20]
    words[7], words[13] = "zebra", "quagmire"
    assert leaks(spark, [(1, around(" ".join(words)))], [(5, TEXT)]) == []


def test_columns_mixed_line_by_line(spark):
    rng = random.Random(4)
    left, right = page(" ".join(ITEM), 25).split("\n"), page(prose(rng, 60), 25).split("\n")
    lines, boxes = [], []
    for i in range(max(len(left), len(right))):
        for x, col in ((10, left), (400, right)):
            if i < len(col):
                lines.append(col[i])
                boxes.append((x + i % 3, 20 * i + (x > 100), 300, 18, 0.9))
    assert leaks(spark, [(1, "\n".join(lines), boxes), (2, "\n".join(lines))], [(5, TEXT)]) == [(1, 5), (2, 5)]


def test_stock_instructions(spark):
    stock = "Read this little notice with care and answer the question below."
    its = [(i, f"{stock} {' '.join(sentence(20 + i))}") for i in range(4)]
    marked = _prepared(items(spark, [*its, (0, its[0][1]), (10, "Mr. Smith"), (11, "Mr. Jones"), (12, "Mr. Brown"), (13, "Other text. Here.")]), "item_id", "text")
    assert {r["item_id"] for r in marked.where("stock").collect()} == {0, 1, 2, 3}
    assert without_first_sentence(its[0][1]) == " ".join(sentence(20)) and without_first_sentence("One only") == ""
    docs = [(1, around(stock)), (2, around(f"{stock} {' '.join(sentence(20)[:8])}")), (3, around(" ".join(sentence(22)[:20])))]
    assert leaks(spark, docs, its) == [(3, 2)]


def test_shared_and_unusable_items(spark):
    docs = [(1, around(" ".join(ITEM)))]
    assert leaks(spark, docs, [(i, TEXT) for i in range(9)]) == [(1, i) for i in range(9)]  # equal items, all found
    assert leaks(spark, docs, [(1, None), (None, TEXT), (2, ""), (3, "too short"), (4, "!!! ???")]) == []
    assert leaks(spark, [], [(1, TEXT)]) == [] and leaks(spark, docs, []) == []
    with pytest.raises(ValueError):
        leaked_items(documents(spark, docs), items(spark, [(1, TEXT)]), min_words=3)


@pytest.mark.parametrize("n", [3, 4, 40])
def test_a_passage_shared_by_many_items(spark, n):
    short = "it was by far the best of all they had in the old inn".split()
    its = [(i, " ".join([*sentence(50 + i, 12), *short, *ITEM[:16], *sentence(150 + i, 12)])) for i in range(n)]
    damaged = " ".join(ITEM[:16])
    middle = len(damaged) // 2
    damaged = f"{damaged[:middle]}q{damaged[middle + 1 :]}"
    docs = [(1, around(" ".join([*short, *ITEM[:1]]))), (2, around(damaged)), (3, around(" ".join(ITEM[:13])))]
    # a page of short words, one of a damaged letter, one of too few words
    assert leaks(spark, docs, its) == [(d, i) for d in (1, 2) for i in range(n)]


def one_wrong_in(rng, text, n):
    """``text`` with one letter in every ``n`` replaced."""
    out = list(text)
    for begin in range(0, len(out), n):
        at = rng.randrange(begin, min(begin + n, len(out)))
        if out[at] != " ":
            out[at] = rng.choice("kvxyz")
    return "".join(out)


@pytest.mark.parametrize("n", [1, 3, 4, 8, 50])
def test_damaged_passages_shared_by_items(spark, n):
    rng = random.Random(n)
    passage = " ".join(sentence(77, 40))
    its = [(i, " ".join([*sentence(500 + i, 10), passage, *sentence(900 + i, 10)])) for i in range(n)]
    docs = [(every * 100 + k, around(one_wrong_in(rng, passage, every), k)) for every in (20, 25, 30, 40, 60) for k in range(4)]
    assert leaks(spark, docs, its) == sorted((d, i) for d, _ in docs for i in range(n))


def test_one_exact_window_is_enough():
    rng = random.Random(3)
    whole = lost = 0
    for seed in range(120):
        words = sentence(3000 + seed, 15)
        text = one_wrong_in(rng, " ".join(words), 24)
        got = list(search_pages([around(text, seed)], Items([(1, " ".join(words))]), min_words=10))
        whole += 1
        lost += not any(n >= 13 for _, _, n in got)  # a wrong letter may cost the word at either end
    assert lost <= whole // 20


@pytest.mark.parametrize("letters", [1, 900, 2_000_000])
def test_items_in_blocks(spark, monkeypatch, letters):
    monkeypatch.setattr(lk, "BLOCK_LETTERS", letters)
    stock = "Read this little notice with care and answer the question below."
    its = [(i, f"{stock} {' '.join(sentence(20 + i))}") for i in range(4)] + [(9, TEXT)]
    docs = [(1, around(f"{stock} {' '.join(sentence(20)[:8])}")), (2, around(TEXT)), (3, around(" ".join(sentence(22)[:20])))]
    assert leaks(spark, docs, its) == [(2, 9), (3, 2)]


def test_links_in_parts_change_nothing(monkeypatch):
    text = page(" ".join(w for k in range(40) for w in (*ITEM[k % 20 : k % 20 + 4], "odd")) + " " + TEXT)
    its = Items([(1, TEXT), (2, " ".join(reversed(ITEM)))])
    want = list(search_pages([text, TEXT, ""], its, min_words=15))
    assert [(k, i) for k, i, n in want if n >= 15] == [(0, 0), (1, 0)]
    for at_once, many in ((1, 64), (50, 64), (16_000_000, 1)):
        monkeypatch.setattr(lk, "LINKS_AT_ONCE", at_once)
        monkeypatch.setattr(lk, "MANY_PIECES", many)
        got = list(search_pages([text, TEXT, ""], its, min_words=15))
        assert [x for x in got if x[2] >= 15] == [x for x in want if x[2] >= 15]


def test_a_page_repeating_a_phrase_of_an_item_ends_soon():
    text = "\n".join(" ".join(ITEM[5:9]) for _ in range(20_000)) + "\n" + TEXT
    assert [n for _, _, n in search_pages([text], Items([(1, TEXT)]), min_words=15)] == [30]


def test_a_very_long_page_is_searched_to_its_end(spark):
    rng = random.Random(5)
    assert leaks(spark, [(1, page(prose(rng, 200_000)) + "\n" + TEXT)], [(5, TEXT)]) == [(1, 5)]


def test_wu_manber_equals_plain_search():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 20_000).astype(np.uint8)
    patterns = [text[i : i + n].copy() for i, n in zip(rng.integers(0, 19_000, 60), rng.integers(WINDOW, 40, 60))]
    patterns += [rng.integers(1, 4, WINDOW).astype(np.uint8) for _ in range(40)] + [patterns[0]]
    start, which = WuManber(patterns).search(text)
    raw = text.tobytes()
    want = set()
    for k, p in enumerate(patterns):
        at = raw.find(p.tobytes())
        while at >= 0:
            want.add((at, k))
            at = raw.find(p.tobytes(), at + 1)
    assert set(zip(start.tolist(), which.tolist())) == want and len(start) == len(want)
    assert WuManber([]).search(text)[0].size == 0 and WuManber(patterns).search(text[:5])[0].size == 0
    with pytest.raises(ValueError):
        WuManber([text[:5]])


def test_letters():
    same = to_letters(["Hen clove 10", "hcu c-\nlo\tve, IO", None, "", "\U0001f600 ß"])
    codes = [same.codes[a:b].tolist() for a, b in zip(same.starts, same.starts[1:])]
    assert codes[0] == codes[1] and codes[2] == codes[3] == [] and len(codes[4]) == 1
    assert Items([(1, "barn clever")]).letters[0].tolist() == to_letters(["bam dever"]).codes.tolist()
    assert to_letters(["barn"]).codes.tolist() == to_letters(["bam"]).codes.tolist()


def test_reading_order_leaves_odd_pages_alone():
    import pyarrow as pa

    kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("w", pa.int32())]))
    box = lambda x, y: {"x": x, "y": y, "w": 100}
    texts = pa.array(["a\nb\nc", None, "a\nb", "x\ny", ""])
    boxes = pa.array([[box(500, 1), box(0, 5), box(3, 2)], None, [box(0, 0)], [box(0, 9), box(0, None)], []], kind)
    assert reading_order(texts, boxes) == ["c\nb\na", "", "a\nb", "y\nx", ""]


def spam_and_prose(n=240):
    """Pages: ordinary ones, and one kind of stuffing for each id from 1000."""
    rng = random.Random(11)
    common = "the of and to in a was by it for".split()
    rows = []
    for i in range(n):
        rows.append((i, page(" ".join(w for _ in range(90) for w in (rng.choice(common), f"{rng.choice(WORDS)}{rng.choice(['', 's', 'ed', 'ing'])}")))))
    keys = ["cheap boots", "buy lamp", "finest soap"]
    kinds = [
        "\n".join(" * ".join(rng.choice(keys) for _ in range(4)) for _ in range(30)),
        "\n".join(f"https://{rng.choice(WORDS)}{k}.example/{rng.choice(WORDS)}" for k in range(30)),
        "\n".join(f"SKU {k} {rng.choice(['sofa', 'chair'])} | new | {rng.choice(['sofa', 'chair'])} sale" for k in range(30)),
        "\n".join(" ".join(f"#{rng.choice(['tonic', 'oil', 'tea'])}{rng.choice(['', 'now', 'buy'])}" for _ in range(4)) for _ in range(30)),
    ]
    rows += [(1000 + k, t) for k, t in enumerate(kinds)]
    rows += [(2000, "\n".join(f"ARRIVED. {rng.choice(WORDS).title()}{k} Maid, salt, from {rng.choice(WORDS).title()}{k}" for k in range(30)))]
    rows += [(2001, rows[0][1] + "\nbuy lamp * buy lamp\nwww.lamp.example/x")]
    return rows


def test_stuffed_pages(spark):
    rows = [*spam_and_prose(), (None, spam_and_prose()[-6][1]), (1000, spam_and_prose()[-6][1]), (3000, None), (3001, ""), (3002, "  \n "), (3003, "12")]
    got = Counter(r["doc_id"] for r in stuffed_pages(documents(spark, rows)).collect())
    assert got == Counter([1000, 1000, 1001, 1002, 1003, None])
    assert stuffed_pages(documents(spark, [])).count() == 0


def test_copies_of_a_stuffed_page_do_not_hide_it(spark):
    rows = spam_and_prose()
    text = dict(rows)[1000]
    # more copies than ordinary pages of that length, and many copies of an ordinary page
    docs = [*rows, *[(5000 + k, text) for k in range(260)], *[(9000 + k, rows[7][1]) for k in range(260)]]
    got = Counter(r["doc_id"] for r in stuffed_pages(documents(spark, docs)).collect())
    assert got == Counter([1000, 1001, 1002, 1003, *range(5000, 5260)])


def test_stuffed_pages_without_others_to_compare_with(spark):
    rows = spam_and_prose()
    long = "\n".join([dict(rows)[1001]] * 40)  # alone in its length class
    got = stuffed_pages(documents(spark, [*rows, (4000, long)])).collect()
    assert {1000, 1001, 1002, 1003, 4000} == {r["doc_id"] for r in got}
    # a table of a few pages (too few words for rates: keywords alone can't be told there)
    few = [rows[0], rows[1], *[r for r in rows if r[0] in (1001, 1003, 2000)]]
    assert sorted(r["doc_id"] for r in stuffed_pages(documents(spark, few)).collect()) == [1001, 1003]
    # fewer ordinary pages than a group needs, as unlike each other as a stuffed page is unlike them
    listing = [(6000 + k, rows[-2][1].replace("Maid", f"Maid{k}")) for k in range(10)]
    assert rows[-2][0] == 2000
    mixed = [*rows[:10], *listing, (1001, dict(rows)[1001]), (1003, dict(rows)[1003])]
    assert sorted(r["doc_id"] for r in stuffed_pages(documents(spark, mixed)).collect()) == [1001, 1003]
    # one ordinary page and a stuffed one
    assert [r["doc_id"] for r in stuffed_pages(documents(spark, [rows[0], (9, dict(rows)[1001])])).collect()] == [9]


def test_curves(spark):
    # frequencies 4, 2, 1: a line through (log rank, log f) by plain least squares
    got = page_curves(documents(spark, [(1, "aa aa aa aa bb bb cc"), (2, "xx yy zz"), (3, "one")])).collect()
    by = {r["doc_id"]: r for r in got}
    x, y = np.log([1, 2, 3]), np.log([4, 2, 1])
    slope, icept = np.polyfit(x, y, 1)
    assert by[1]["slope"] == pytest.approx(slope) and by[1]["residual"] == pytest.approx(float(np.sqrt(np.mean((y - slope * x - icept) ** 2))))
    assert by[2]["slope"] == 0.0 and by[2]["residual"] == 0.0 and by[3]["n_words"] == 1


def test_words_of_pages():
    w = to_words(["Bell be1l BELL béll barn bam a", None, "see http://a.b/c, (www.x.example) hosts.test #tea 8.15 6d c0rset", " \n\n* *\n12\nend.The next", "x" * 3000 + " " + "x" * 2999 + "y", "ничто Ничто"])
    page = [w.word[a:b].tolist() for a, b in zip(w.starts, w.starts[1:])]
    assert len(set(page[0][:4])) == 1 and page[0][4] == page[0][5] and len(page[0]) == 6
    assert page[1] == []
    assert page[2][1:3] == [ADDRESS, ADDRESS] and page[2][3] == ADDRESS and page[2][4] == TAG and page[2][6:9] == [NUMBER] * 3 and page[2][9] not in (NUMBER, ADDRESS)
    assert w.lines.tolist() == [1, 0, 1, 3, 1, 1] and ADDRESS not in page[3] and page[3][0] == NUMBER
    assert page[4][0] != page[4][1] and page[5][0] == page[5][1]
    assert w.line[w.starts[3] :][:2].tolist() == [3, 4]  # lines of spaces are left out, those without words are not
    assert to_words([]).word.size == 0 and to_words([None, ""]).lines.tolist() == [0, 0]


def test_the_curves_alone_tell_stuffed_pages_from_prose(spark):
    rng = random.Random(2)
    listing = lambda: "\n".join(f"ARRIVED. {rng.choice(WORDS).title()}{k} Maid, salt, from {rng.choice(WORDS).title()}{k}" for k in range(30))
    rows = [*spam_and_prose(), *[(3000 + k, listing()) for k in range(25)]]
    judged = {r["doc_id"]: r for r in flagged(page_curves(documents(spark, rows), half=True)).collect()}
    # a kind of listing that is part of the language's rates is ordinary
    assert {i for i, r in judged.items() if r["flag"]} == {1000, 1001, 1002, 1003}
    assert all(judged[1000 + k]["divergence"] > judged[2000]["divergence"] for k in range(4))


def test_a_page_half_of_prose(spark):
    rows = spam_and_prose()
    prose = rows[3][1].split("\n")
    tags = dict(rows)[1002].split("\n")
    mixed = lambda n: "\n".join(x for pair in zip(prose[:10], tags[:10]) for x in pair) + "\n" + "\n".join(tags[10 : 10 + n])
    got = {r["doc_id"] for r in stuffed_pages(documents(spark, [*rows, (7000, mixed(0)), (7001, mixed(4))])).collect()}
    assert got == {1000, 1001, 1002, 1003, 7001}


@pytest.mark.parametrize("n", [6, 90])
def test_pages_of_a_small_language(spark, n):
    shift = str.maketrans("abcdefghijklmnopqrstuvwxyz", "nopqrstuvwxyzabcdefghijklm")
    rows = spam_and_prose()
    strange = [(8000 + k, rows[k][1].translate(shift)) for k in range(n)]
    keys = (8900, dict(rows)[1000].translate(shift))
    df = documents(spark, [*rows, *strange, keys]).withColumn("lang", F.when(F.col("doc_id") >= 8000, "xx").otherwise(F.col("lang")))
    assert {r["doc_id"] for r in stuffed_pages(df).collect()} == {1000, 1001, 1002, 1003, 8900}


def test_many_stuffed_pages_do_not_hide_each_other(spark):
    rows = spam_and_prose()
    rng = random.Random(5)
    goods = [f"{a}{b}" for a in ("boot", "lamp", "soap", "ton", "curt", "mang", "kett", "pian") for b in ("le", "ic", "ain", "o")]
    many = []
    for k in range(90):
        keys = rng.sample(goods, 4)
        many.append((6000 + k, "\n".join(" ".join(rng.choice(keys) for _ in range(5)) for _ in range(30))))
    got = {r["doc_id"] for r in stuffed_pages(documents(spark, [*rows, *many])).collect()}
    assert got == {1000, 1001, 1002, 1003, *range(6000, 6090)}


def exact(sizes, capacity):
    """Fewest containers, by trying."""
    best = len(sizes)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(sizes):
            best = len(room)
            return
        for k in {r: k for k, r in enumerate(room) if r >= sizes[i]}.values():
            room[k] -= sizes[i]
            place(i + 1, room)
            room[k] += sizes[i]
        place(i + 1, [*room, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def test_bounds_are_bounds():
    rng = random.Random(7)
    tight = 0
    for _ in range(150):
        capacity = rng.choice([10, 12, 30])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        fewest, low = exact(sizes, capacity), lower_bound(np.array(sizes), capacity)
        box = best_fit_decreasing(np.array(sizes), capacity)
        load = Counter()
        for b, s in zip(box.tolist(), sizes):
            load[b] += s
        assert low <= fewest <= len(load) and max(load.values()) <= capacity
        tight += low == fewest
    assert tight > 120 and lower_bound(np.array([], int), 10) == 0


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, None, 5, 700, 2048, 2049, 5000, rng.randint(1, 1500)]), 1, "c") for i in range(400)] + [(7, 300, 1, "c")] * 3 + [(None, 40, 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, uid int, container string")
    out = pack(df, 2048)
    got = out.collect()
    load, parts = Counter(), defaultdict(list)
    for r in got:
        assert (r["container"] is None) == (r["tokens"] == 0)
        load[r["container"]] += r["tokens"]
        parts[r["doc_id"]].append((r["piece"], r["start"], r["tokens"]))
    assert max(load.values()) <= 2048 and sum(load.values()) == sum(r[1] or 0 for r in rows)
    for i, size, *_ in rows:
        pieces = sorted(parts[i])
        if i == 7:
            continue
        if size and size > 2048:
            assert pieces == [(k, k * 2048, min(2048, size - k * 2048)) for k in range(-(-size // 2048))]
        else:
            assert pieces == [(0, 0, size or 0)]
    assert sum(1 for p in parts[7] if p == (0, 0, 300)) >= 3
    report = packing_report(out, 2048).first()
    n = len([b for b in load if b is not None])
    assert report["n_containers"] == n and report["lower_bound"] <= n <= report["lower_bound"] + 1
    assert pack(df.limit(0)).count() == 0 and packing_report(pack(df.limit(0))).first()["n_containers"] == 0
    with pytest.raises(ValueError):
        pack(df, 0)


def test_partitions_with_gaps_exchange(spark, monkeypatch):
    # two pieces fit into a container: every partition with an odd number of them has half a container to give
    monkeypatch.setattr("skyloom.llm.packing.PIECES", 10)
    df = spark.createDataFrame([(i, 700) for i in range(200)], "doc_id long, tokens long")
    got = pack(df, 2048)
    report = packing_report(got, 2048).first()
    first = _packed(df.select(F.col("doc_id").alias("uid"), "tokens"), 200, 2048, 0).groupBy("part").count().collect()
    assert got.count() == 200 and report["lower_bound"] == 100
    assert any(r["count"] % 2 for r in first)
    assert report["n_containers"] <= 105
    turns = {r["container"] >> 56 for r in got.collect()}
    assert len(turns) > 1  # some were packed again


def test_whole_table_bounds_agree_with_the_functions(spark):
    sizes = [rng_size for rng_size in (5, 700, 1030, 1024, 2048, 33, 900, 1500)]
    df = spark.createDataFrame([(s,) for s in sizes], "tokens long")
    best = max(df.selectExpr(f"ceil(({s}) / 2048) AS b").first()["b"] for s in bound_sums(2048))
    assert best <= exact(sizes, 2048) and best <= lower_bound(np.array(sizes), 2048)


def test_token_counts(spark):
    docs = documents(spark, [(1, "the ferry crossed the harbour"), (2, None), (3, ""), (None, "x" * 100_000), (4, "<|endoftext|>")])
    got = {r["doc_id"]: r["tokens"] for r in token_counts(docs).collect()}
    assert got[2] == got[3] == 0 and got[1] >= 5 and got[None] > 100 and got[4] > 1


def test_thousands_of_items(spark):
    its = [(i, " ".join(sentence(i, 18))) for i in range(25_000)]
    docs = [(k, around(its[k * 1000][1])) for k in range(25)]
    found = leaks(spark, docs, its)
    assert set(found) >= {(k, k * 1000) for k in range(25)}


def test_certificates_and_checks(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, None, 700, 2048, 2049, 5000, rng.randint(1, 1500)])) for i in range(300)] + [(7, 300), (7, 4100), (None, 40)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    out = spark.createDataFrame(pack(df, 2048).collect(), "doc_id long, piece long, start long, tokens long, container long")
    certs = packing_certificates(out).collect()
    assert sum(r["containers"] for r in certs) == packing_report(out).first()["n_containers"]
    assert all(r["bound"] <= r["containers"] and r["certified"] == (r["bound"] == r["containers"]) for r in certs)
    good = packing_checks(out, df).collect()
    assert len(good) == 301 and all(r["complete"] and r["cut_rightly"] and r["fits"] for r in good)
    wrong = lambda changed: {r["doc_id"]: (r["complete"], r["cut_rightly"], r["fits"]) for r in packing_checks(changed, df).collect()}
    size = dict(rows[:300])
    small, big = next(i for i in range(10, 300) if size[i] == 700), next(i for i in range(10, 300) if size[i] == 5000)
    assert wrong(out.where(F.col("doc_id").isNull() | (F.col("doc_id") != small)))[small] == (False, False, False)  # lost
    assert wrong(out.union(out.where(F.col("doc_id") == small)))[small][0] is False  # twice
    assert wrong(out.where(~((F.col("doc_id") == big) & (F.col("piece") == 1))))[big][:2] == (False, False)
    full = out.withColumn("container", F.when(F.col("container").isNotNull(), 1))
    assert wrong(full)[small] == (True, True, False)  # all in one
    assert packing_checks(out.limit(0), df.limit(0)).count() == 0 and packing_certificates(out.limit(0)).count() == 0
