import itertools
import random

import numpy as np
import pytest

from quorumdf.llm import bpe, consensus, duplicates, languages, lookalike, overlap, packing, pii, queries
from quorumdf.llm.chars import fold
from quorumdf.llm.pii_examples import LABELLED, UNLABELLED, carriers, sequences
from quorumdf.sources.tables import table
from tests.llm import held_out
from tests.oracle import DATA, compare, connection


def frame(spark, rows, shape):
    return spark.createDataFrame(rows, shape)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])


# -- 1 ---------------------------------------------------------------------------------------------------------------
def answers(spark, rows):
    full = [(f"k{i}", *r) if len(r) == 6 else r for i, r in enumerate(rows)]
    return frame(spark, full, "key string, pool_id long, question string, model string, probs string, created_at string, loaded_at string").selectExpr("key", "pool_id", "question", "model", "probs", "cast(created_at as timestamp) created_at", "cast(loaded_at as timestamp) loaded_at", "'x' as votes", "'y' as q")


def asked(spark):
    return frame(spark, [("q", "choice", ["a", "b", "c"]), ("q", "choice", ["a", "b", "c"]), (None, "choice", ["a"])], "question string, kind string, options array<string>")


def test_votes_edge_cases(spark):
    t = "2025-01-01 00:00:0"
    rows = [
        (1, "q", "Vend/M ", "[0.2, 0.5, 0.3]", t + "1", None),
        (1, "q", "m", "[0.9, 0.1, 0.0]", t + "0", None),  # older answer of the same model
        (1, "q", "n", "[1, 1, 0]", t + "1", None),  # tie: the first option
        (2, "q", "m", None, t + "1", None),
        (2, "q", "n", "[0.1, 0.2", t + "1", None),
        (2, "q", "o", "[0.5, 0.5]", t + "1", None),
        (2, "q", "p", "[0, 0, 0]", t + "1", None),
        (2, "q", "r", "[NaN, 1, 0]", t + "1", None),
        (2, "q", "s", "", t + "1", None),
        (None, "q", "m", "[1, 0, 0]", t + "1", None),
        (3, None, "m", "[1, 0, 0]", t + "1", None),
        (3, "q", None, "[1, 0, 0]", t + "1", None),
        (3, "zz", "m", "[1, 0, 0]", t + "1", None),
        (4, "q", "m", "[1, 0, 0]", None, None),
    ]
    got = {r["pool_id"]: [(v["model"], v["label"]) for v in r["votes"]] for r in consensus.votes(answers(spark, rows), asked(spark)).collect()}
    assert got == {1: [("m", 1), ("n", 0)], 4: [("m", 0)]}
    assert consensus.consensus(answers(spark, rows).filter("false"), asked(spark)).count() == 0


def test_consensus_finds_spammers_liars_and_echoes(spark):
    r = random.Random(4)
    options, rows, truth = ["a", "b", "c"], [], {}
    for i in range(900):
        t = truth[i] = r.randrange(3)
        noisy = lambda acc: t if r.random() < acc else (t + r.choice((1, 2))) % 3
        echo = noisy(0.55)
        said = {"good": noisy(0.9), "fair": noisy(0.75), "spam": 0 if r.random() < 0.95 else r.randrange(3), "liar": (t + 1) % 3 if r.random() < 0.9 else t, "base": echo, "copy": echo}
        for m, s in said.items():
            rows.append((i, "q", m, str([0.8 if k == s else 0.1 for k in range(3)]), "2025-01-01", None))
    df = answers(spark, rows)
    got = {r["pool_id"]: r for r in consensus.consensus(df, asked(spark)).collect()}
    right = np.mean([got[i]["answer"] == options[t] for i, t in truth.items()])
    assert len(got) == 900 and right > 0.95
    assert all(0 < g["confidence"] <= 1 and 0 <= g["agreement"] <= 1 and g["answers"] == 6 for g in got.values())
    rel = {r["model"]: r for r in consensus.reliability(df, asked(spark)).collect()}
    assert rel["base"]["echo_of"] == rel["copy"]["echo_of"] and rel["good"]["echo_of"] == "good"
    assert rel["good"]["accuracy"] > 0.85 > rel["fair"]["accuracy"] > rel["base"]["accuracy"] > rel["liar"]["accuracy"]
    assert rel["spam"]["guesses"][0] > 0.8
    assert rel["good"]["reliability"] > 0.8 > rel["fair"]["reliability"] and abs(rel["spam"]["reliability"]) < 0.15 and rel["liar"]["reliability"] < -0.1
    plain = {x["pool_id"]: x["answer"] for x in consensus.consensus(df, asked(spark), plain=True).collect()}
    assert set(plain) == set(got) and 0.5 < np.mean([plain[i] == options[t] for i, t in truth.items()]) < right
    with pytest.raises(ValueError):
        consensus.start(["q"], ["m"] * 2000, [["x"] * 100])


# -- 2 ---------------------------------------------------------------------------------------------------------------
COPIES = [
    ("Order 12 is late, please help.", 1),
    ("order 12 IS late\tplease help", 1),
    ("Ｏｒｄｅｒ 12 is lаte, please​ help.", 1),
    ("Order 13 is late, please help.", 2),
    ("Plan: Duo | New plan: Solo | Note: all fine", 3),
    ('{"Note": "all fine", "New plan": "Solo", "Plan": "Duo"}', 3),
    ("- note:  All fine.\n- plan:  duo\n- new plan:  SOLO", 3),
    ("New plan=Solo; Plan=Duo; Note=all fine!", 3),
    ("Plan: Solo | New plan: Duo | Note: all fine", 4),
    ("Grüße aus Köln", 5),
    ("GRÜSSE AUS KÖLN", 5),
    ("Gruße aus Koln", 6),
    ("СРОЧНЫЙ ЗАКАЗ", 7),
    ("срочный заказ!", 7),
    ("", 8),
    ("  \n", 8),
    ("...", 8),
]


def test_contents(spark):
    rows = [(i, t) for i, (t, _) in enumerate(COPIES)] + [(100, None), (101, None)]
    df = frame(spark, rows, "pool_id long, text string").selectExpr("*", "1 as content", "2 as group")
    got = {r["copy_id"]: r["keep_id"] for r in duplicates.found(df).collect()}
    first = {}
    want = {i: first[c] for i, (_, c) in enumerate(COPIES) if first.setdefault(c, i) != i}
    assert got == want
    sizes = {r["keep_id"]: r["copies"] for r in duplicates.distinct(df).collect()}
    assert sum(sizes.values()) == len(rows) and sizes[0] == 3 and sizes[100] == 1
    assert duplicates.found(df.filter("false")).count() == 0


def test_fast_path_equals_slow_path(spark):
    rows = [(r["pool_id"], r["text"]) for r in table(spark, DATA, "pool_labeled", "pool_id", "text").collect()]
    got = {r["id"]: r["content"] for r in duplicates.keyed(frame(spark, rows, "pool_id long, text string"), "pool_id", "text").collect()}
    assert all(got[i] == (None if t is None else duplicates.canonical_content(t)) for i, t in rows)


def test_colliding_hashes_are_told_apart_by_content(spark):
    from pyspark.sql import functions as F

    rows = [(1, "alpha one"), (2, "Alpha-One"), (3, "beta two"), (4, "BETA two!"), (5, "gamma"), (6, "alpha ONE")]
    df = frame(spark, rows, "pool_id long, text string")
    for hashed in (F.md5, lambda c: F.substring(F.md5(c), 1, 0), lambda c: F.substring(c, 1, 4)):  # sound, one for all, one for a few
        members, repeated = duplicates.collapse(df, hashed=hashed)
        got = {(r["id"], r["keep_id"], r["copies"]) for r in members.join(repeated, "group").collect()}
        assert got == {(1, 1, 3), (2, 1, 3), (6, 1, 3), (3, 3, 2), (4, 3, 2)}


def test_content_by_hand():
    """Written out, apart from the tables of the operator."""
    same = [("Rеfund №12", "refund 12"), ("ＡＢ c", "abc"), ("a\u200bb", "AB"), ("Name: Jo; Plan: X", '{"plan": "x", "name": "jo"}'), ("ÉTÉ", "été"), ("СОРТ", "сорт")]
    other = [("refund 12", "refund 13"), ("ete", "été"), ("Name: Jo; Plan: X", "Name: X; Plan: Jo")]
    assert all(duplicates.canonical_content(a.replace("№", "")) == duplicates.canonical_content(b) for a, b in same)
    assert all(duplicates.canonical_content(a) != duplicates.canonical_content(b) for a, b in other)


def test_hot_content_is_whole(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    assert duplicates.found(frame(spark, rows, "pool_id long, text string")).count() == 999


# -- 3 ---------------------------------------------------------------------------------------------------------------
def _by_kind(texts, tagged):
    hit, said, there = ({k: 0 for k in pii.KINDS} for _ in range(3))
    for (text, spans), found in zip(texts, tagged):
        a = {(k, pii.bare(text[x:y])) for x, y, k in spans}
        b = {(k, pii.bare(text[x:y])) for x, y, k in found}
        for count, items in ((hit, a & b), (said, b), (there, a)):
            for kind, _ in items:
                count[kind] += 1
    return {k: (hit[k] / there[k], hit[k] / said[k]) for k in pii.KINDS}


def test_tagger_on_sentences_it_was_not_trained_on():
    """Recall and precision of each kind over carrier sentences none of which is in the labelled table, with values of another seed."""
    held = [carriers(x) for x in (held_out.LABELLED, held_out.UNLABELLED)]
    assert not {x.lower() for rows in held for x in rows} & {x.lower() for x in carriers(LABELLED) + carriers(UNLABELLED)}
    texts, listed = sequences(1500, 77, *held)
    own = pii.trained().with_list(listed)
    for kind, (recall, precision) in _by_kind(texts, own.tag([t for t, _ in texts])).items():
        assert recall > (0.8 if kind == "name" else 0.9) and precision > (0.88 if kind == "name" else 0.9), (kind, recall, precision)


def test_tagger_on_a_split_of_its_own_table():
    """Trained without a fifth of the sentences and tested on those alone, values of another seed: what is known by shape stays, names need their contexts."""
    part = lambda table, test: [x for i, x in enumerate(carriers(table)) if (i % 5 == 0) == test]
    texts, listed = sequences(3000, 11, part(LABELLED, False), part(UNLABELLED, False))
    tagger = pii.Tagger(frozenset(listed))
    tagger.fit(texts)
    texts, listed = sequences(800, 77, part(LABELLED, True), part(UNLABELLED, True))
    for kind, (recall, precision) in _by_kind(texts, tagger.with_list(listed).tag([t for t, _ in texts])).items():
        least = 0.7 if kind == "name" else 0.85
        assert recall > least and precision > least, (kind, recall, precision)


def test_personal_items_are_found_and_replaced(spark):
    names = frame(spark, [("Zora", "given"), (None, "given"), ("Zora", "given")], "name string, kind string")
    text = "My name is Zora Breman. Call me on 428-555-0101. Write to zora.b@mail.example.net, not to the shop. My SSN is 941772096. We are at 25 Dreor Street, Heton 95500, second gate."
    df = frame(spark, [(1, text), (2, None), (3, ""), (4, "Order 12345678 arrived. " * 2000), (1, text)], "pool_id long, text string").selectExpr("*", "1 as kind", "2 as found")
    got = {(r["row_id"], r["kind"], r["found"]) for r in pii.found({"pool_labeled": (df, "pool_id")}, names).collect()}
    assert got == {(1, "name", "zorabreman"), (1, "phone", "4285550101"), (1, "email", "zorabmailexamplenet"), (1, "id_number", "941772096"), (1, "address", "25dreorstreetheton95500")}
    out = {r["pool_id"]: r["redacted"] for r in pii.redact(df, names, "pool_id").collect()}
    assert out[1] == "My name is [NAME]. Call me on [PHONE]. Write to [EMAIL], not to the shop. My SSN is [ID_NUMBER]. We are at [ADDRESS], second gate."
    assert out[2] is None and out[3] == "" and out[4].startswith("Order 12345678")
    assert pii.found({"t": (df.filter("false"), "pool_id")}, names.filter("false")).count() == 0


def test_every_row_of_both_tables_is_redacted(spark):
    """Every row, seed_dev's too, comes out once for each time it stands in its table, with a placeholder wherever an item was found."""
    out = queries.p3_redacted(spark, DATA).collect()
    want = [("pool_labeled", r["pool_id"]) for r in table(spark, DATA, "pool_labeled", "pool_id").collect()] + [("seed_dev", r["seed_id"]) for r in table(spark, DATA, "seed_dev", "seed_id").collect()]
    assert sorted((r["table_name"], r["row_id"]) for r in out) == sorted(want)
    hit = {(r["table_name"], r["row_id"]) for r in queries.p3_found(spark, DATA).collect()}
    assert {(r["table_name"], r["row_id"]) for r in out if r["items"]} == hit and any(t == "seed_dev" for t, _ in hit)
    assert all("[" in r["redacted"] for r in out if r["items"])


def test_tagger_starts_afresh():
    texts = [f"My name is Zora Breman. w{chr(97 + i % 26)}{chr(97 + i // 26)} " * 3 for i in range(60)] + [" ".join(f"{a}{b}{c}" for a in "abcdef" for b in "abcdef" for c in "abcdef")]
    small, large = pii.trained().with_list(()), pii.trained().with_list(())
    small.most = 40
    assert small.tag(texts) == large.tag(texts) and small.most > 40


def test_tagger_cuts_known_pieces_once(monkeypatch):
    """Words met before are not cut into tokens again, and the pieces have the tokens of the whole text."""
    cut, seen = pii._TOKEN, []

    class Counted:
        def findall(self, text):
            seen.append(len(text))
            return cut.findall(text)

        finditer = cut.finditer

    r = random.Random(6)
    texts = [" ".join(r.choice("the parcel came late again, please look into it: código überall".split()) for _ in range(40)) for _ in range(200)]
    tagger = pii.trained().with_list(())
    with monkeypatch.context() as m:
        m.setattr(pii, "_TOKEN", Counted())
        tagger.tag(texts)
    assert sum(seen) < 0.05 * sum(map(len, texts))
    bits = "0|12|(0|0)|)|(|[|.|,|-|/| |  |\n|\t|\u00a0|mr.|Dr.|a.|st.| at |[at]|(AT)| dot |.com|word|é|İ|@| @ |+0|00-00|_|’|0 mr. x".split("|")
    for _ in range(20_000):
        text = "".join(r.choices(bits, k=7))
        assert tagger._ids(text) == [tagger.types[t] for t in cut.findall(pii._zeroed(text))], text


def test_places_survive_folding():
    text = "Nam​е: Ｚora"
    folded, at = pii.aligned(text)
    assert folded == "Name: Zora" and text[at[6] : at[9] + 1] == "Ｚora"


# -- 4 ---------------------------------------------------------------------------------------------------------------
def test_trie_automaton():
    trie = lookalike.Trie(["сорт", "cop", "naïve", "word"])
    assert trie.search("сoрт") == {"сорт": 0}
    assert trie.search("сор") == {"cop": 0}
    assert trie.search("naïv​e") == {"naïve": 0}
    assert trie.search("wurd") == {} and trie.search("wurd", 1) == {"word": 1} and trie.search("ord", 1) == {"word": 1}
    assert lookalike.canonical("сорт", {"сорт": 0}) == "сорт" and lookalike.canonical("ｘ", {}) == "x"


def test_automaton_reads_what_the_table_cannot():
    """A sign drawn like two letters, and a sign drawn like two different ones: the vocabulary decides, where the table knows one reading or none."""
    trie = lookalike.Trie(["lamp", "Item", "ijs", "VIII", "džem"])
    for token, word in (("\u04c0amp", "lamp"), ("\u04c0tem", "Item"), ("\u04cftem", "Item"), ("\u0133s", "ijs"), ("\u2167", "VIII"), ("\u01c6em", "džem")):
        assert trie.search(token) == {word: 0} and lookalike.canonical(token, trie.search(token)) == word and lookalike.skeleton(token) == lookalike.skeleton(word)
        assert (fold(token) == word) == (token == "\u04c0tem")
    both = lookalike.Trie(["lamp", "Iamp"])
    assert both.search("\u04c0amp") == {"lamp": 0, "Iamp": 0} and lookalike.canonical("\u04c0amp", both.search("\u04c0amp")) == "Iamp"
    assert trie.search("lteм") == {} and trie.search("iamp") == {}


def test_pairs_by_hand(spark):
    """Written out, apart from the character table: what looks the same and what does not."""
    rows = ["Refund 12", "Rеfund 12", "Ｒefund １２", "Re\u200bfund 12", "Refund\u00a012", "refund 12", "Refund  12", "Refund 12.", "Réfund 12", "Re\u0301fund 12", "Ref\u00adund 13", "Refund 13", "lamp", "\u04c0amp", "\ufb01le", "file", "ijs", "\u0133s"]
    groups = ({0, 1, 2, 3, 4}, {8, 9}, {10, 11}, {12, 13}, {14, 15}, {16, 17})
    want = {(a, b) for g in groups for a, b in itertools.combinations(sorted(g), 2)}
    got = {tuple(x) for x in lookalike.pairs(frame(spark, list(enumerate(rows)), "pool_id long, text string")).collect()}
    assert got == want


def test_pairs_of_a_hot_text_are_whole_by_both_ways(spark, monkeypatch):
    rows = [(i, "one text") for i in range(400)] + [(400, "onе text"), (401, "оne text"), (402, "onе text")]
    df = frame(spark, rows, "pool_id long, text string")
    want = {(a, b) for a in range(400) for b in (400, 401, 402)} | {(400, 401), (401, 402)}
    for few in (lookalike.FEW, 0):
        monkeypatch.setattr(lookalike, "FEW", few)
        monkeypatch.setattr(lookalike, "TRIE_WORDS", 2)
        got = [tuple(x) for x in lookalike.pairs(df, per_salt=50).collect()]
        assert len(got) == len(want) and set(got) == want


def test_pairs_equal_brute_force(spark):
    words = ["Order", "for", "café", "сорт", "12", "team", "naïve"]
    r, odd = random.Random(6), {"o": "оο", "e": "е", "a": "аɑ", "c": "с", "р": "p", "1": "１", "m": "ｍ"}
    rows = [(0, None), (1, ""), (2, " "), (3, "👨‍👩"), (4, "👨👩"), (5, "a  b"), (6, "a b"), (7, "a b"), (8, "Café"), (9, "Café"), (10, "cafe")]
    for i in range(11, 150):
        t = " ".join(words[j % len(words)] for j in range(i % 7, i % 7 + 3))
        if r.random() < 0.6:
            t = "".join(r.choice(odd.get(c, c)) + ("​" if r.random() < 0.1 else "") for c in t)
        rows.append((i, t))
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x is not None and y is not None and x != y and fold(x) == fold(y)}
    df = frame(spark, rows, "pool_id long, text string").selectExpr("*", "1 as own", "2 as normal")
    got = [tuple(x) for x in lookalike.pairs(df, per_salt=7).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (6, 7) in want and (3, 4) not in want and (5, 6) not in want
    normal = {x["pool_id"]: x["normal"] for x in lookalike.normalize(df, "pool_id").collect()}
    assert all((normal[a] == normal[b]) == (fold(x) == fold(y)) for (a, x), (b, y) in itertools.combinations(rows, 2) if x is not None and y is not None)
    assert normal[0] is None and lookalike.pairs(df.filter("false")).count() == 0


# -- 5 ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("least", [0.8, 0.6])
def test_overlap_equals_brute_force(spark, least):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    evaluation = [(i, " ".join(r.sample(vocabulary, r.randrange(1, 14)))) for i in range(60)] + [(60, None), (61, ""), (62, "!?"), (63, " ".join(vocabulary * 40 + [f"x{i}" for i in range(300)]))]
    training = [(1000 + i, None) for i in range(2)] + [(1002, "...")]
    for i in range(200):
        w = evaluation[r.randrange(60)][1].split()
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        r.shuffle(w)
        training.append((2000 + i, " ".join(w).upper()))
    training += [(3000, evaluation[63][1] + " y1 y2"), (3001, training[-1][1]), (3002, training[-1][1])]
    want = {(a, b) for a, x in evaluation for b, y in training if (u := overlap.words(x) | overlap.words(y)) and len(overlap.words(x) & overlap.words(y)) / len(u) >= least - 1e-9}
    shape = "id long, text string"
    got = [(x["eval_id"], x["train_id"]) for x in overlap.pairs(frame(spark, evaluation, shape), frame(spark, training, shape), least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert overlap.pairs(frame(spark, evaluation, shape).filter("false"), frame(spark, training, shape)).count() == 0


def test_repeated_rows_give_repeated_pairs(spark):
    shape = "id long, text string"
    got = overlap.pairs(frame(spark, [(1, "a b c"), (1, "a b c")], shape), frame(spark, [(7, "c b a"), (8, "C B A")], shape)).collect()
    assert sorted((r["eval_id"], r["train_id"]) for r in got) == [(1, 7), (1, 7), (1, 8), (1, 8)]


# -- 6 ---------------------------------------------------------------------------------------------------------------
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library():
    r = random.Random(2)
    texts = ["", "<|endoftext|>", "Ġthe the Ġ", "a" * 4000, " " * 500 + "x", "ÃÂ" * 200, "don't I'LL we're", "\x00\x1c\x85"]
    texts += ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(0x20, 0x250), r.randrange(0x400, 0x500), r.randrange(0x2000, 0x3100), r.randrange(0x1F300, 0x1F700)))) for _ in range(r.randrange(60))) for _ in range(2000)]
    got = bpe.tokenizer().encode_batch(texts)
    assert got == [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


def test_ids_of_the_table(spark):
    rows = table(spark, DATA, "documents", "doc_id", "text")
    t, text = library(), {r["doc_id"]: r["text"] for r in rows.collect()}
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(rows).collect()}
    assert set(got) == set(text) and all(got[i] == (t.encode(x, add_special_tokens=False).ids if x else []) for i, x in text.items())
    assert {r["doc_id"]: r["tokens"] for r in bpe.lengths(rows).collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.encode(rows.filter("false")).count() == 0


# -- 7 ---------------------------------------------------------------------------------------------------------------
def test_first_fit_equals_the_plain_loop():
    rng = np.random.default_rng(3)
    for capacity in (1, 7, 100):
        sizes = rng.integers(0, capacity + 1, 300)
        bins: list[int] = []
        want = np.empty(300, int)
        for i in np.argsort(-sizes, kind="stable"):
            k = next((j for j, left in enumerate(bins) if left >= sizes[i]), None)
            if k is None:
                k = len(bins)
                bins.append(capacity)
            bins[k] -= sizes[i]
            want[i] = k
        assert (packing.first_fit_decreasing(sizes, capacity) == want).all()


def test_packing_keeps_everything(spark):
    rows = [(i, s) for i, s in enumerate([0, None, 5, 9, 10, 11, 25, 3, 3, 3] * 30)]
    items = frame(spark, rows, "doc_id long, tokens int").selectExpr("*", "1 as bin", "2 as capacity")
    kinds = frame(spark, [("s", 10), ("l", 40), ("s", 10), ("none", None), ("bad", 0)], "container string, capacity int")
    got = packing.pack(items, kinds, group_docs=60).collect()
    for kind, capacity in (("s", 10), ("l", 40)):
        own = [r for r in got if r["container"] == kind]
        used, sums = {}, {}
        for r in own:
            used[r["bin_group"], r["bin"]] = used.get((r["bin_group"], r["bin"]), 0) + r["tokens"]
            sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["tokens"]
            assert r["start"] == r["piece"] * capacity
        assert max(used.values()) <= capacity and sums == {i: s or 0 for i, s in rows}
        assert all(r["piece"] == 0 for r in own if (dict(rows)[r["doc_id"]] or 0) <= capacity)
        assert sum(used.values()) / (len(used) * capacity) > 0.8
    twice = kinds.union(frame(spark, [("s", 8)], "container string, capacity int"))
    filled = {r["container"]: r for r in packing.fill(packing.pack(items, twice, group_docs=60), twice).collect()}
    assert set(filled) == {"s", "l"} and filled["s"]["bins"] == len({(r["bin_group"], r["bin"]) for r in got if r["container"] == "s"}) and 0.8 < filled["s"]["filled"] <= 1
    assert packing.pack(items.filter("false"), kinds).count() == 0 and packing.pack(items, kinds.filter("false")).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def profiles(spark):
    return languages.fit(table(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text", "lang"))


def test_label_spellings(spark):
    rows = [("en-US", "en"), ("English", "en"), ("eng", "en"), (" DE ", "de"), ("de_AT", "de"), ("Português", "pt"), ("nld", "nl"), ("unknown", None), ("und", None), ("", None), (" ", None), ("??", None), ("n/a", None), (None, None)]
    from pyspark.sql import functions as F

    got = frame(spark, rows, "a string, b string").withColumn("c", languages.label_language(F.col("a"))).collect()
    assert all(r["b"] == r["c"] for r in got)


def test_documents_and_stretches(spark, profiles):
    en, de, nl = "The parcel has not arrived and nobody answered my letter.", "Das Paket ist leider nicht angekommen und niemand meldet sich.", "Het pakket is nog niet aangekomen en niemand reageert."
    rows = [
        (1, f"{en} {en} {de}", "en"),
        (2, f"{de}\n{de}\n[12:00:01] 0xabc rapo\n{en}\n{de}", None),
        (3, nl, "de"),
        (4, nl.upper(), "Dutch"),
        (5, "12345 0xff\n{a:1,b:null}\n🙂", "en"),
        (6, None, "en"),
        (7, "", None),
        (8, "A" * 500, "fr"),
        (9, " ".join([en] * 2000), "nl"),
        (9, en, "en"),
    ]
    df = frame(spark, rows, "doc_id long, text string, lang string").selectExpr("*", "1 as letters", "2 as confidence")
    got = {}
    for r in languages.stretches(df, profiles).filter("doc_id <> 9").collect():
        got.setdefault(r["doc_id"], []).append((r["seg_no"], r["lang"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, "en"), (2, "de")], 2: [(1, "de"), (2, "en"), (3, "de")], 3: [(1, "nl")], 4: [(1, "nl")]}
    found = {(r["doc_id"], r["labelled"], r["lang"]) for r in languages.assign(df, profiles).filter("doc_id in (2, 3, 5, 6)").collect()}
    assert found == {(2, None, "de"), (3, "de", "nl"), (5, "en", None), (6, "en", None)}
    assert languages.assign(df.filter("false"), profiles).count() == 0


def test_stretches_lie_in_the_text_itself(spark, profiles):
    en, de = "The parcel has not arrived, no\u200bbody answered my ｌｅｔｔｅｒ.", "Das Paket ist leider nicht a\u0308hnlich und ﬁndet sich nicht."
    text = f"\ufeff {en} {en}\n{de}  👨\u200d👩 {de}"
    got = languages.stretches(frame(spark, [(1, text)], "doc_id long, text string"), profiles).orderBy("seg_no").collect()
    assert [r["lang"] for r in got] == ["en", "de"] and all(0 <= r["confidence"] <= 1 for r in got)
    assert [text[r["start"] : r["end"]].strip("\ufeff ") for r in got] == [f"{en} {en}", f"{de}  👨\u200d👩 {de}"]
    at = languages.origins("e\u0301ﬁ\u200bx👨\u200d👩")
    assert at == [0, 2, 2, 4, 5, 6, 7, 8]


def test_a_single_word_is_a_stretch_if_it_says_enough(spark, profiles):
    en = "The parcel has not arrived and nobody answered my letter."
    got = languages.stretches(frame(spark, [(1, f"{en}\nЗдравствуйте\n{en}"), (2, f"{en}\nok\n{en}")], "doc_id long, text string"), profiles).collect()
    assert sorted((r["doc_id"], r["seg_no"], r["lang"]) for r in got) == [(1, 1, "en"), (1, 2, "ru"), (1, 3, "en"), (2, 1, "en")]


def test_sample_is_that_of_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.when(F.col("id") % 50 == 0, "de").otherwise("en").alias("__lang"), F.xxhash64("id").alias("__hash"))
    hashes = {}
    for r in rows.collect():
        hashes.setdefault(r[0], []).append(r[1])
    for sample in (1, 30, 300, 10_000):
        assert languages._hash_limits(rows, sample) == {k: sorted(v)[min(sample, len(v)) - 1] for k, v in hashes.items()}
    assert languages._hash_limits(rows.filter("false"), 10) == {}


def test_labels_agree_with_profiles(spark, profiles):
    """Most labels of the table are right, so most must agree."""
    got = languages.assign(table(spark, DATA, "documents", "doc_id", "text", "lang"), profiles).filter("labelled is not null and lang is not null")
    assert got.filter("labelled = lang").count() / got.count() > 0.8
    assert connection() is not None
