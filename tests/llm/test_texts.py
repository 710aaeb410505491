import random

import pytest

from nichelens.llm.eval_leaks import leaks, without_leaks, words_of
from nichelens.llm.languages import LANGUAGES, _Evidence, detect, fit, label_code, label_column, text_passages
from nichelens.llm.line_shapes import page_shapes
from nichelens.llm.mixing import mixture, ordered, queue_positions, shares, token_sizes

# --- problem 5 ---
SENTENCES = {
    "en": ["The seller ships from a warehouse nearby and it was here within a week.", "I keep one in the kitchen because they do break.", "Nobody mentions that the coating scratches after the first evening."],
    "de": ["Der Händler hat uns nach drei Tagen eine neue Lieferung versprochen.", "Ich frage mich, warum das Regal im Keller immer so schnell kaputt wirkt.", "Wer hat einen Tipp, wie man das Ding wieder sauber bekommt?"],
    "fr": ["Nous cherchons un modèle qui tient dans la cuisine sans faire de bruit.", "Ma sœur a rendu la sienne parce qu'elle était trop fragile.", "Je trouve que le casque est vraiment cher, surtout au bureau."],
    "es": ["No entiendo por qué nadie fabrica esto para personas zurdas.", "El cargador se rompió ayer mismo y el vendedor todavía no contesta.", "Mi hermana lo usa en la oficina y dice que es bastante frágil."],
    "it": ["Qualcuno sa dove posso trovare un modello che non sia così utile?", "Il coltello si è rotto proprio ieri e il venditore non risponde più.", "Mia sorella lo usa in cantina e dice che è abbastanza debole."],
    "pt": ["Não percebo por que ninguém faz uma versão para casas pequenas.", "O que mais me incomoda é o barulho que ele faz na garagem.", "O carregador quebrou ontem e o vendedor ainda não respondeu."],
    "nl": ["Weet iemand hoe je zoiets weer goed schoon krijgt?", "De winkel heeft ons vorige zomer een nieuwe levering beloofd.", "Mijn zus zegt dat de mat in de keuken helemaal niet nodig is."],
    "sv": ["Butiken har efter första tvätten lovat oss en ny leverans.", "Är det någon som vet hur man får den ren igen?", "Kabeln står nu i källaren och är enligt mig mycket högljudd."],
}


@pytest.fixture(scope="module")
def filters():
    rng = random.Random(1)
    sample = [(k, " ".join(rng.sample(v, 2))) for k, v in SENTENCES.items() for _ in range(30)]
    sample += [("sv", SENTENCES["en"][0])] * 4 + [("en", "I bought the Okubrix mat and the Okubrix hose.")] * 5
    return fit(sample)


def test_languages_of_texts_and_passages(filters):
    e = _Evidence(filters)
    for k, v in SENTENCES.items():
        for s in v:
            assert [x[0] for x in detect(s, e)] == [k]
            assert [x[0] for x in detect(s.upper(), e)] == [k]
    for a, b in (("en", "de"), ("es", "pt"), ("nl", "sv"), ("fr", "it")):
        for sep in (" ", "\n\n", " // ", " | "):
            found = detect(SENTENCES[a][0] + sep + SENTENCES[b][0] + sep + SENTENCES[b][1], e)
            assert [x[0] for x in found] == [a, b] and all(0 <= x[1] <= 1 for x in found)
        assert [x[0] for x in detect(" ".join([SENTENCES[a][1], SENTENCES[b][1], SENTENCES[a][2]]), e)] == [a, b, a]


def test_texts_without_language(filters):
    e = _Evidence(filters)
    for t in (None, "", "???", "24 x 64 x 71 cm", "😀 👍", "https://a.example/p/1 #usbhub", "Okubrix 633X", "+50", "3/5 !!!"):
        assert detect(t, e) == [], t


def test_false_positives_are_corrected(filters):
    assert len(LANGUAGES) == 8 and (filters.false < 1e-4).all()
    assert filters.evidence(["qxzvk"]).max() < 0.2
    full = type(filters)()
    full.cells[:] = 255
    full.false[:] = 1 - 1e-9
    assert full.evidence(["warehouse"]).max() <= 1


def test_labels(spark):
    cases = {"en-US": "en", "English": "en", "deu": "de", "pt_BR": "pt", "xx": None, "n/a": None, "": None, None: None, " FR ": "fr"}
    assert {k: label_code(k) for k in cases} == cases
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r.l: r.c for r in df.select("l", label_column(df.l).alias("c")).collect()} == cases


def test_passages_in_spark(spark, filters):
    rows = [(1, SENTENCES["en"][0], None, 9), (2, SENTENCES["de"][0] + " " + SENTENCES["fr"][0], "de", 9), (3, None, "en", 9), (4, "", "en", 9), (None, "x", "en", 9), (5, " ".join(SENTENCES["nl"]) * 3000, "nl", 9)]
    got = {(r.chunk_id, r.seg_no, r.lang, r.n_langs) for r in text_passages(spark.createDataFrame(rows, "id long, text string, lang string, seg_no int"), filters).collect()}
    assert got == {(1, 1, "en", 1), (2, 1, "de", 2), (2, 2, "fr", 2), (5, 1, "nl", 1)}


# --- problem 6 ---
def brute_leaks(docs, items, n=10):
    out = {}
    for d, t in docs:
        a = words_of(t)
        for i, u in items:
            b = words_of(u)
            best = max((k for x in range(len(a)) for y in range(len(b)) for k in [next((k for k in range(min(len(a) - x, len(b) - y) + 1) if k == min(len(a) - x, len(b) - y) or a[x + k] != b[y + k]), 0)]), default=0)
            if best >= n:
                out[(d, i)] = best
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(14)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(25))) for i in range(6)] + [(9, "too short"), (10, None)]
    docs = [(k, " ".join(rng.choice(vocab + ["other"]) for _ in range(40))) for k in range(25)]
    for k in range(25, 45):
        w = rng.choice(items[:6])[1].split()
        a = rng.randrange(10)
        docs.append((k, "intro, " + " \n ".join(x.upper() + rng.choice(["", "!", " &mdash;", "<br>"]) for x in w[a : a + rng.randrange(8, 15)]) + " other end"))
    docs += [(50, None), (51, ""), (52, "x " * 50_000 + items[0][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs] + [(*docs[30], 1)], "doc_id long, text string, item_id int")
    it = spark.createDataFrame(items + [items[0]], "item_id long, text string")
    want = brute_leaks([d for d in docs if d[0] < 52], [x for x in items if x[1]])
    want[(52, 0)] = 25
    for block in (10**6, 120):
        got = leaks(df, it, block_chars=block).collect()
        assert {(r.doc_id, r.item_id): r.n_words for r in got} == want and len(got) == len(want)
    by = dict(docs)
    for r in got:
        a, b = words_of(by[r.doc_id]), words_of(dict(items)[r.item_id])
        assert a[r.doc_word : r.doc_word + r.n_words] == b[r.item_word : r.item_word + r.n_words]
    left = {r.doc_id for r in without_leaks(df, it).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert leaks(df, it.limit(0)).count() == 0 and leaks(df.limit(0), it).count() == 0


def test_repeated_phrases_stay_linear():
    import time

    import pandas as pd

    from nichelens.llm.eval_leaks import TestSuffixes, _search

    def run(items, docs, n):
        found = list(_search(iter([pd.DataFrame({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]})]), TestSuffixes([{"item_id": i, "text": t} for i, t in items], n)))
        return sorted(pd.concat(found).values.tolist()) if found else []

    began = time.time()
    assert run([(1, "buy now " * 1200)], [(7, "buy now " * 12_000)], 10) == [[7, 1, 2400, 0, 0]] and time.time() - began < 5
    rng = random.Random(2)
    for _ in range(120):
        letters = "abcdefg"[: rng.randrange(1, 7)]
        items = [(i, " ".join(rng.choice(letters) for _ in range(rng.randrange(0, 25)))) for i in range(3)]
        docs = [(d, " ".join(rng.choice(letters + "z") for _ in range(rng.randrange(0, 40)))) for d in range(4)]
        n, want = rng.randrange(2, 5), []
        for d, x in docs:
            for i, y in items:
                a, b, best = x.split(), y.split(), None
                for p in range(len(a)):
                    for q in range(len(b)):
                        k = 0
                        while p + k < len(a) and q + k < len(b) and a[p + k] == b[q + k]:
                            k += 1
                        best = min(best or (0, 0, 0), (-k, p, q)) if k >= n else best
                if best:
                    want.append([d, i, -best[0], best[1], best[2]])
        assert run(items, docs, n) == sorted(want)


# --- problem 7 ---
def test_mixture_against_a_queue(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", "z", None]), rng.choice([0, 1, 5, 9, 40])) for i in range(300)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    wanted = [(1, "a", 0.5, 1), (1, "b", 0.3, 3), (1, "c", 0.2, 2), (2, "a", 0.1, 1), (2, "b", 0.9, 1), (3, "q", 1.0, 3), (4, "a", 0.9, 4), (4, "c", 0.5, 2), (5, "b", 1.0, 50)]
    targets = spark.createDataFrame(wanted, "mix_id int, source string, target_share double, max_repeats int")
    budget, place = sum(t for *_, t in docs), {r.doc_id: r.h for r in sizes.select("doc_id", F.xxhash64("doc_id", F.lit(1)).alias("h")).collect()}
    want = set()
    for mix in {w[0] for w in wanted}:
        queue = []
        for _, source, share, most in [w for w in wanted if w[0] == mix]:
            mine = sorted((d for d in docs if d[1] == source), key=lambda d: (place[d[0]], d[0]))
            whole, served = sum(d[2] for d in mine), 0
            for d in mine:
                served += d[2]
                queue += [((c * whole + served) / share, source, d[0], c + 1, d[2]) for c in range(most)]
        total = 0
        for _, source, doc, copy, tokens in sorted(queue):
            total += tokens
            if total <= budget:
                want.add((mix, source, doc, copy))
    got = [(r.mix_id, r.source, r.doc_id, r.copy) for r in mixture(sizes, targets).collect()]
    assert set(got) == want and len(got) == len(want)
    rows = {(r.mix_id, r.source): r for r in shares(sizes, targets).collect()}
    assert all(r.short == (sum(d[2] for d in docs if d[1] == k[1]) * r.max_repeats < r.target_share * budget) for k, r in rows.items()) and rows[(4, "c")].short


def test_token_sizes(spark):
    docs = spark.createDataFrame([(1, "Hello world", "a", "x"), (1, "Hello world", "a", "x"), (2, None, None, "x"), (3, "<|endoftext|>", "b", "x"), (None, "q", "a", "x")], "doc_id long, text string, source string, tokens string")
    got = {r.doc_id: (r.source, r.tokens) for r in token_sizes(docs).collect()}
    assert got[1] == ("a", 2) and got[2] == (None, 0) and got[3][1] > 1 and set(got) == {1, 2, 3}


def test_queue_positions_are_running_totals(spark):
    import nichelens.llm.mixing as m

    sizes = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i % 5}", i % 7) for i in range(300)], "doc_id long, source string, tokens long")
    old, m.SLICE_ROWS = m.SLICE_ROWS, 20
    try:
        rows = queue_positions(sizes).collect()
    finally:
        m.SLICE_ROWS = old
    for s in {r.source for r in rows}:
        mine = sorted((r.served, r.tokens) for r in rows if r.source == s)
        total = 0
        seen = 0
        for served, t in mine:
            seen = max(seen, served)
            total += t
        assert seen == total and len(mine) == sum(1 for r in rows if r.source == s)


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(7)
    sizes = [(i, rng.choice(["big", "big", "big", "mid", "small"]), rng.randrange(1, 30)) for i in range(900)] + [(1000, None, 50)]
    df = spark.createDataFrame(sizes, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([(1, "big", 0.5, 2), (1, "mid", 0.3, 4), (1, "small", 0.2, 1), (2, "big", 0.9, 1), (2, "none", 0.1, 3), (3, "none", 1.0, 1), (4, "big", None, 2)], "mix_id int, source string, target_share double, max_repeats int")
    budget = sum(t for *_, t in sizes)
    on_hand = {s: sum(t for _, q, t in sizes if q == s) for s in ("big", "mid", "small")}
    rows = {(r.mix_id, r.source): r for r in shares(df, targets).collect()}
    assert {k for k, r in rows.items() if r.short} == {(m, s) for m, s, w, c in ((1, "big", 0.5, 2), (1, "mid", 0.3, 4), (1, "small", 0.2, 1), (2, "big", 0.9, 1), (2, "none", 0.1, 3), (3, "none", 1.0, 1)) if on_hand.get(s, 0) * c < w * budget}
    assert rows[(1, "small")].taken == on_hand["small"] and rows[(4, "big")].taken == 0 and rows[(3, "none")].actual_share is None
    assert budget - 30 <= sum(r.taken for k, r in rows.items() if k[0] == 1) <= budget
    assert rows[(1, "big")].actual_share / rows[(1, "mid")].actual_share == pytest.approx(5 / 3, rel=0.05)
    mixed = mixture(df, targets)
    m = mixed.collect()
    assert len({(r.mix_id, r.doc_id, r.copy) for r in m}) == len(m) and max(r.copy for r in m if r.source == "big" and r.mix_id == 1) <= 2
    taken = [r for r in m if r.mix_id == 1]
    last = max((r.finish, r.source, r.doc_id, r.copy) for r in taken)
    assert not [r for r in mixture(df, targets, budget=10**9).collect() if r.mix_id == 1 and (r.finish, r.source, r.doc_id, r.copy) < last and (r.doc_id, r.copy) not in {(x.doc_id, x.copy) for x in taken}]
    assert [r.finish for r in ordered(mixed.where("mix_id = 1")).collect()] == sorted(r.finish for r in taken)
    assert shares(df.limit(0), targets).where("taken > 0").count() == 0 and shares(df, targets.limit(0)).count() == 0


# --- problem 8 ---
PROSE = "The seller ships from a warehouse nearby, so it was here in a month. I keep one in the kitchen, because they do break. We measured 27 millimetres of play in the frame before it lost its grip. "
SPAM = {
    "tags": " ".join(f"#tag{i}deal" for i in range(60)), "links": "\n".join(f"https://shop{i}.example/{i}" for i in range(30)), "anchors": "".join(f'<a href="https://x{i}.test/c/{i}">clip on mat {i}</a><br>' for i in range(20)),
    "keywords": ", ".join(f"{w} sun hat" for w in "best cheap buy order top sale price outlet".split() * 4), "plain": " ".join(f"{w} sun hat" for w in "best cheap buy order top sale price outlet".split() * 4),
    "products": " | ".join(f"Brand{i} leak proof scoop {i}.79 USD in stock" for i in range(12)), "stuffed": "Buy sun hat here because this sun hat is the best sun hat. Best sun hat online: sun hat sale, sun hat price. " * 5,
    "lines": "\n".join(f"wall mounted comb {i}m" for i in range(30)),
}
FINE = {
    "prose": PROSE * 3, "short tags": PROSE * 2 + "\n\nTags: #mat #hat #comb", "facts": PROSE * 2 + "\n\n- Weight: 300 g\n- Colour: red\n", "commented links": "".join(f"https://x{i}.example/{i} {s.strip()}\n" for i, s in enumerate(PROSE.split(". ")) if s.strip()) * 2 + PROSE * 2,
    "german": "Der Händler hat uns im letzten Sommer eine neue Lieferung versprochen. Ich frage mich, warum das Regal im Keller immer so schnell kaputt wirkt. " * 3, "wrapped": PROSE.replace(" so", "\nso").replace(" in", "\nin") * 3, "markup": f"<div><p>{PROSE}</p><p>{PROSE}</p></div>",
}


def test_pages(spark):
    rows = [(i, t) for i, t in enumerate([*SPAM.values(), *FINE.values()])]
    rows += [(100, None), (101, ""), (102, "?!"), (103, PROSE + SPAM["tags"] * 3), (104, PROSE * 6 + SPAM["tags"])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, shape int")
    got = {r.doc_id: r for r in page_shapes(df).collect()}
    for i, name in enumerate(SPAM):
        assert got[i].flagged and got[i].loose_shapes >= 1 and got[i].main_shape, name
    for i, name in enumerate(FINE):
        assert not got[len(SPAM) + i].flagged, name
    assert got[103].flagged and not got[104].flagged and not {100, 101, 102} & set(got)
    assert page_shapes(df.limit(0)).count() == 0
    twice = {r.doc_id: r.flagged for r in page_shapes(df.union(df)).collect()}
    assert twice == {k: r.flagged for k, r in got.items()}


def test_prose_of_other_languages_is_no_spam(spark):
    texts = [
        "Ostin tämän lampun keittiöön viime talvena. Se toimii hyvin, mutta johto on liian lyhyt. Suosittelen sitä silti kaikille ystäville.",
        "Я купил эту лампу для кухни прошлой зимой. Она работает хорошо, но провод слишком короткий. Всё равно советую её друзьям.",
        "先週このランプを台所のために買いました。とても明るいですが、コードが短すぎます。それでも友達に勧めます。",
        "Kupiłem tę lampę do kuchni zeszłej zimy. Działa dobrze, ale przewód jest za krótki. Mimo to polecam ją znajomym.",
    ]
    rows = [(i, t) for i, t in enumerate([*texts, *SPAM.values()])]
    got = {r.doc_id: r.flagged for r in page_shapes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(i for i, f in got.items() if f) == list(range(len(texts), len(rows)))
