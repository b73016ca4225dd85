"""Keyword and link pages, told from speech and from lists of the record."""

import random

import numpy as np
import pytest

from tickloom.llm import spam as S

SPEECH = {
    "en": ["I thank the Minister for the statement that she has made today.", "We have waited for an answer on the harbour dues since the spring.", "The committee heard that nobody had asked the people who work there.", "It is not only the cost of the bridge, it is the time that is lost."],
    "de": ["Ich danke dem Minister für die Erklärung, die er heute abgegeben hat.", "Wir warten seit dem Frühjahr auf eine Antwort zu den Hafengebühren.", "Der Ausschuss hat gehört, dass niemand die Beschäftigten gefragt hat.", "Es geht nicht nur um die Kosten der Brücke, sondern auch um die Zeit."],
    "fr": ["Je remercie le ministre de la déclaration qu'il a faite aujourd'hui.", "Nous attendons depuis le printemps une réponse sur les droits de port.", "La commission a entendu que personne n'avait consulté les agents.", "Ce n'est pas seulement le coût du pont, c'est aussi le temps perdu."],
}


def speech(rng, lang, n):
    return " ".join(rng.choice(SPEECH[lang]) for _ in range(n))


def pages():
    rng = random.Random(1)
    good = {}
    for lang in SPEECH:
        for k in range(200):
            good[f"{lang}{k}"] = speech(rng, lang, rng.randint(4, 14))
    names = [f"{a}{b}" for a in ("Ash", "Bor", "Cal", "Dun", "Eld", "Fen", "Gor") for b in ("ford", "wick", "ley", "ton", "by")]
    good["roll"] = "AYES (35)\n" + "  ".join(names)
    good["places"] = ", ".join(names) + "."
    good["sums"] = "\n".join(f"{k}. the harbour dues ({n}), £{k * 3} million" for k, n in enumerate(names[:20], 1))
    good["prices"] = "\n".join(f"{w} {k} per cent" for k, w in enumerate("kettle carpet lamp shelf bicycle drill curtain tent mattress freezer".split(), 3))
    good["rhetoric"] = "We will not wait. " * 12 + speech(rng, "en", 3)
    good["strip"] = speech(rng, "en", 12) + "\nHome 3 (pdf) | Login 4 (pdf) | cheap kettle"
    bad = {
        "links": "\n".join(f"https://www.shop{k}.example.com/a/{k}.html" for k in range(30)), "menu": " | ".join(f"{w} {k} (pdf)" for k, w in enumerate(["Home", "Archive", "Login", "Members"] * 6)),
        "repeat": "\n".join(["red kettle", "oak shelf", "red kettle"] * 12), "tags": "Tags: oak drill, lamp, boots, tent / Keywords: vintage kettle, carpet, shelf, drill, lamp",
        "hashtags": " ".join(f"#{w}" for w in ["cheapkettle", "oakshelf", "bestprice"] * 8), "codes": "\n".join(f"oak lamp XL – {k}.99 – discount – SKU {k}4711" for k in range(9, 30)),
        "combos": ", ".join(f"{a} waterproof shelf {b}" for a in ("cheap", "buy", "best", "wholesale") for b in ("online", "near me", "price", "sale")),
        "disguised": " - ".join(["v4cuum cl34n3r", "VACUUM CLEANER", "vacuum clеaner", "v a c u u m"] * 6), "sentences": "Looking for used cars? We have used cars, lamps and more used cars. Our used cars are the best used cars for your used cars needs. Order used cars today and get lamps online. " * 4,
        "german": "Jetzt Lampe bestellen, Lampe vergleichen, Lampe sparen.\nLampe günstig kaufen, Lampe billig online, Lampe Angebot Rabatt.\n" * 5, "mixed": speech(rng, "en", 2) + "\n" + "\n".join(["red kettle", "oak shelf"] * 40),
    }
    # what makes words known: link lists and repetitions of the same trade elsewhere in the corpus
    trade = {"en": "kettle shelf lamp drill boots tent carpet oak red used cars vintage waterproof cheap buy best wholesale online price sale near discount sku order looking get".split(), "de": "Lampe bestellen vergleichen sparen günstig kaufen billig online Angebot Rabatt jetzt".split()}
    for lang, words in trade.items():
        for k in range(10):
            some = rng.sample(words, 6)
            bad[f"{lang}_links{k}"] = " | ".join(f"[{a} {b}](https://m.{a}{k}.example/x)" for a, b in zip(some, some[1:]))
            bad[f"{lang}_tags{k}"] = "Tags: " + ", ".join(rng.sample(words, 8)) + " / Keywords: " + ", ".join(rng.sample(words, 8))
            bad[f"{lang}_again{k}"] = " ".join(rng.choices(rng.sample(words, 7), k=60))
    return good, bad


@pytest.fixture(scope="module")
def shares(spark):
    good, bad = pages()
    names = [*good, *bad]
    label = {n: n[:2] for n in good if n[:2] in SPEECH and n[2:].isdigit()}
    label |= {"en3": "de", "en4": " EN", "en5": "en-GB", "en6": "?", "en7": ""}  # wrong, odd and empty ones
    rows = [(k, (good | bad)[n], label.get(n)) for k, n in enumerate(names)]
    rows += [(9001, None, "en"), (9002, "", "en"), (9003, "  \n", "en"), (None, "plain words of the house", "en"), (9004, ".", "en"), (9005, "kettle " * 40_000, "en"), (9006, "\u200b", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label string").selectExpr("*", "1 as lang", "2 as chars", "3 as features", "4 as word", "5 as codes")
    out = {r["doc_id"]: r["spam_share"] for r in S.page_shares(df, df.doc_id, df.text, df.label).collect()}
    return {n: out[k] for k, n in enumerate(names)}, out


def test_spam_is_found_and_the_record_is_not(shares):
    by_name, _ = shares
    good, bad = pages()
    assert {n: by_name[n] for n in bad if by_name[n] <= S.SHARE} == {}
    assert {n: by_name[n] for n in good if by_name[n] > S.SHARE} == {}


def test_defined_cases(shares):
    _, out = shares
    assert not {9001, 9002, 9003, 9006} & set(out)
    assert out[9005] > 0.9 and out[None] <= S.SHARE and out[9004] <= S.SHARE


def test_empty_table_and_no_labels(spark):
    df = spark.createDataFrame([(1, "x y", None)], "doc_id bigint, text string, lang string")
    assert S.spam_pages(df.limit(0)).count() == 0
    assert S.spam_pages(df).count() == 0


def test_function_words_are_learned(spark):
    good, _ = pages()
    rows = [(k, good[n], n[:2]) for k, n in enumerate(n for n in good if n[2:].isdigit())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    table = S.function_words(S.page_tokens(df, df.doc_id, df.text, df.lang))
    number = lambda w: S.token_code(w) >> 28
    assert len(table) == 3 and all(table[k, number(w)] for k, w in ((0, "der"), (1, "the"), (2, "la")))
    assert not table[:, number("kettle")].any()


def features(text, table=None):
    codes = S.Tokens().of(text)
    return S.unit_features(codes, np.array([len(codes)]), np.zeros((0, 1 << S.BITS), bool) if table is None else table)


def test_tokens_are_told_apart():
    kind = lambda t: S.token_code(t) & 7
    cases = {"https://a.b/c": S.LINK, "//x.y": S.LINK, "shop.co.uk/a?b=1": S.LINK, "laden.de": S.LINK, "#tag_1": S.TAG, "7": S.NUMBER, "word": S.WORD, "Wick-sur-Orle": S.WORD, "\n": S.LINE, "!": S.STOP, ",": S.MARK}
    for text, want in cases.items():
        assert S._TOKEN.findall(text) == [text] and kind(text) == want, text
    known = S.Tokens()
    assert known.of("a  b\r\nc\u200bd\xa0ﬁn").tolist() == [S.token_code(t) for t in ("a", "b", "\n", "cd", "fin")]
    assert S._TOKEN.findall("the end.Next") == ["the", "end", ".", "Next"]
    assert S.token_code("v4cuum") >> 28 == S.token_code("VACUUM") >> 28 and S.token_code("v4cuum") & S.DISGUISED


def test_repetition_of_words_pairs_and_items():
    at = {n: k for k, n in enumerate(f for f in S.FEATURES if f != "affinity")}
    x = features("red kettle\noak shelf\nred kettle\noak shelf\nred kettle\n")["features"]
    assert (x[[0, 2, 4], at["repeat_in_page"]] > 160).all() and not x[[1, 3], at["repeat_in_page"]].any()
    x = features("We like the oak shelf as an oak shelf.")["features"]
    assert x[0, at["repeat_in_unit"]] == round(200 * 4 / 9)
    assert not features("(oak shelf) (oak shelf)")["features"][0, at["repeat_in_unit"]]
    assert features("kettle 8 per cent, shelf 9 per cent")["features"][0, at["amounts"]] == 200


@pytest.mark.parametrize("seed", [1, 2])
def test_times_equal_a_count(seed):
    rng = np.random.default_rng(seed)
    group, item = rng.integers(0, 50, 4000), rng.integers(0, 9, 4000)
    both = [*zip(group.tolist(), item.tolist())]
    seen = {b: both.count(b) for b in set(both)}
    assert S._times(group, item, 50).tolist() == [seen[b] for b in both]


def test_pages_in_blocks_equal_pages_alone():
    rng = random.Random(3)
    texts = [speech(rng, "en", rng.randint(1, 6)) + rng.choice(["", "\nTags: oak, oak, oak", "\n" + "red kettle, " * 30]) for _ in range(40)]
    known = S.Tokens()
    codes = [known.of(t) for t in texts]
    whole = S.unit_features(np.concatenate(codes), np.array([len(c) for c in codes]), np.zeros((0, 1 << S.BITS), bool))
    alone = [features(t) for t in texts]
    for f in ("chars", "features", "n_words", "words"):
        assert np.array_equal(whole[f], np.concatenate([a[f] for a in alone])), f


def test_units_are_finite():
    for text in ("x", "…", "a" * 100_000, "Ã¼ber alles", "1 2 3", "#", "(((", ")))", ": : :", "a: b: c", "\n\n"):
        x = features(text)
        assert len(x["chars"]) == len(x["features"]) and (x["chars"] > 0).all()
