"""Base patterns against plain regular expressions, and what the methods add."""

import hashlib
import itertools
import math
import pickle
import random
import re
import time

import numpy as np
import pytest

from quillgraph.llm import pii, secrets
from quillgraph.llm.spans import PII_KINDS, SECRET_KINDS, in_order, luhn, pii_spans, secret_spans

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def plain_pii(text):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return in_order(out, PII_KINDS)


def plain_secrets(text):
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return in_order(out, SECRET_KINDS)


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_are_those_of_the_patterns(seed):
    r = random.Random(seed)
    for _ in range(4000):
        text = "".join(r.choice(["a", "b.", "@", "1", "23", "255", ".", "-", " ", "+", "(", ")", "4111111111111111", "ab", "c@d.e", "é", "٣"]) for _ in range(r.randint(0, 25)))
        assert pii_spans(text) == plain_pii(text), text
        text = "".join(r.choice(["password", "Token", "api_key", "apikey", "secret", " ", "=", ":", "'", '"', "abcd", "12345678", "AKIA", "ABCDEFGH1234", "deadbeef", "0" * 20, "ſ", "K"]) for _ in range(r.randint(0, 14)))
        assert secret_spans(text) == plain_secrets(text), text


def test_long_texts_take_linear_time():
    begin = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 150_000, "1.1.1." * 60_000, "token" + " " * 300_000, "password=" * 40_000, "+1 " * 100_000):
        pii_spans(text), secret_spans(text), pii.tag([text], pii.train()), secrets.scan(text)
    assert time.time() - begin < 30


def test_field_adds_what_resembles_a_found_span():
    text = "call +1 (442) 555-2960 or 442-555-2960; mail ab.24@mail6.example.com, ab.24 answers. Version 2.0. order 123456 +1 (269) 555-3296 4524132264652876 end"
    (base, full), (clean, none) = pii.tag([text, "Version 2.0, room 12, 2024-01-02, id 123456."], pii.train())
    found = {(text[a:b], k) for a, b, k in full}
    assert set(base) <= set(full)
    assert {("442-555-2960", "phone"), ("ab.24", "email"), ("4524132264652876", "card")} <= found
    assert not any("2.0" in t or "123456" == t for t, _ in found)
    assert clean == none == []


def test_a_match_reaches_every_mention():
    weights = pii.train()
    for text in ("call +1 (555) 123-4567 now. " + "again 123-4567 and " * 40, "again 123-4567 and " * 40 + "call +1 (555) 123-4567 now. "):
        (_, full), (_, none) = pii.tag([text, text.replace("+1 (555) 123-4567", "us")], weights)
        assert len(full) == 41 and {k for *_, k in full} == {"phone"} and none == []
    text = "mail john.smith@example.com or ask John.Smith or (john.smith); but jane.smith is out"
    base, full = pii.tag([text], weights)[0]
    assert [text[a:b] for a, b, _ in base] == ["john.smith@example.com"]
    assert [text[a:b] for a, b, _ in full] == ["john.smith@example.com", "John.Smith", "john.smith"]


def test_numbers_side_by_side_stay_apart():
    weights = pii.train()
    card = "4111/1111/1111/1111"
    text = f"4111111111111111 paid; {card} {card} x; +1 (442) 555-2960 or (442) 555-2960 y"
    (_, full), = pii.tag([text], weights)
    found = [text[a:b] for a, b, _ in full]
    assert found.count(card) == 2 and "(442) 555-2960" in found


def test_edges_of_a_run():
    cut = lambda t: t[slice(*pii._trimmed(t, 0, len(t)))]
    assert cut("(442) 555-2960,") == "(442) 555-2960" and cut("(john.smith).") == "john.smith" and cut("442) 555") == "442) 555"
    assert cut("((a) b)") == "(a) b" and cut("[5 (442)]") == "5 (442)" and cut("(12") == "12" and cut("12)!") == "12" and cut("(<>)") == "" and cut("") == ""


def test_marginals_are_exact_on_chains():
    """Sum-product on a tree gives the marginals that adding up all labellings gives."""
    rng = np.random.default_rng(2)
    for size in (2, 4, 5):
        graph = pii.Graph()
        tokens = [f"{rng.integers(10**k)}" for k in rng.integers(2, 12, size)]
        graph.add(tokens, [(20 * i, 20 * i + 19) for i in range(size)], [set() for _ in tokens])
        graph.chain, graph.skip = [(i, i + 1) for i in range(size - 2)], [(0, size - 1)]
        unary, pair = rng.normal(size=(pii.N_FEATURES, 5)), rng.normal(size=(2, 5, 5))
        x = graph.arrays()[0] @ unary
        want = np.zeros((size, 5))
        for labels in itertools.product(range(5), repeat=size):
            score = sum(x[i, k] for i, k in enumerate(labels)) + sum(pair[0][labels[a], labels[b]] for a, b in graph.chain) + sum(pair[1][labels[a], labels[b]] for a, b in graph.skip)
            for i, k in enumerate(labels):
                want[i, k] += math.exp(score)
        got = pii.beliefs((unary, pair), graph)
        assert np.abs(got - want / want.sum(1, keepdims=True)).max() < 1e-3


def test_texts_are_tagged_in_parts_alike(monkeypatch):
    texts = ["call +1 (555) 123-4567 or 123-4567", "", "x 4111111111111111 4111/1111/1111/1111", "a.b@c.de a.b"] * 3
    whole = pii.tag(texts, pii.train())
    monkeypatch.setattr(pii, "TAGGED_CHARS", 10)
    assert pii.tag(texts, pii.train()) == whole and pii.tag([], pii.train()) == []


def test_messages_settle():
    graph = pii.Graph()
    for text in ("call 123-4567 " * 60, "x +1 (555) 123-4567 mail a.b@c.de a.b 555-123-4567 4111 4111 " * 5):
        tokens = text.split(" ")[:-1]
        graph.add(tokens, [(i * 2, i * 2 + 1) for i in range(len(tokens))], [{"email"} if "@" in x else set() for x in tokens])
    assert abs(pii.beliefs(pii.train(), graph) - pii.beliefs(pii.train(), graph, 5000)).max() < 1e-6
    assert abs(pii.beliefs(pii.train(), graph) - pii.beliefs(pii.train(), graph, 8)).max() > 1e-6


def test_guess_costs_order_values():
    cost = secrets.guess_cost
    assert cost("") == 0
    assert cost("password1") < cost("Summer2024!") < cost("x9$Kp2!vQ7")
    assert cost("aaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 4 and cost("20240131") < 5 and cost("abcabcabc") < 6
    text = 'login: x9$Kp2!vQ7 then pwd is Tr0ub4dor&3xyz and passphrase = "changeme" done; the pin was not given'
    base, full = secrets.scan(text)
    assert base == [] and [text[a:b] for a, b, k in full] == ["x9$Kp2!vQ7", "Tr0ub4dor&3xyz"]


def test_guess_cost_alone_decides():
    text = "pwd: qZxKvTrWpLmNbHgF and password is wkqjzvhxbnrtpmdy; the password is required, login to continue, secret is forgotten"
    assert [text[a:b] for a, b, _ in secrets.scan(text)[1]] == ["qZxKvTrWpLmNbHgF", "wkqjzvhxbnrtpmdy"]


def test_texts_are_not_left_out_before_the_scan(spark):
    names = ["password", "passcode", "pwd", "secret", "token", "credentials", "login", "pin"]
    names += [f"{a}{b}{c}" for a in ("api", "access", "auth", "private", "client") for b in ("", " ", "_", "-") for c in ("key", "secret", "token", "code")]
    rows = [(i, f"Your {name} is 7fK!29xq") for i, name in enumerate(names)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: secrets.scan(text)[1] for i, text in rows} and all(got.values())


def segment_price(value, i, j, ranks):
    """The cheapest way to guess value[i:j] as one segment, each kind by its definition."""
    part, low = value[i:j], value[i:j].lower()
    prices = [secrets.alphabet(value)] if j - i == 1 else []
    word = secrets.word_price(part, low, low.translate(secrets._LEET), ranks)
    if word is not None and j - i >= 3:
        prices.append(word)
    prices += [price for form, price in secrets._DATES if form.fullmatch(part)]
    steps = [secrets._step(a, b) for a, b in zip(low, low[1:])]
    if j - i >= 3 and all(steps):
        prices.append(secrets.WALK_START + secrets.WALK_STEP * len(steps) + secrets.WALK_TURN * sum(a != b for a, b in zip(steps, steps[1:])))
    for p in range(1, 9):
        if (j - i) % p == 0 and (j - i) // p >= 2 and j - i >= 3 and part == part[:p] * ((j - i) // p):
            prices.append(p * secrets.alphabet(value) + math.log10((j - i) // p))
    return min(prices, default=math.inf)


@pytest.mark.parametrize("seed", range(4))
def test_guess_cost_is_the_cheapest_of_all_cuts(seed):
    r = random.Random(seed)
    ranks = secrets.Ranks(["pass", "word", "password", "qwe", "user", "rty", "asdfg", "sword", "aaa"])
    pieces = ["qwerty", "asdfgh", "123456", "abcdef", "aaaa", "aa", "abab", "abcabc", "20240131", "2024", "31.12.1999", "12/31/2001", "pass", "p4ss", "Word", "user", "zx", "9", "Q", "!", "7531", "ewq", "xyz"]
    for _ in range(150):
        value = "".join(r.choice(pieces) for _ in range(r.randint(1, 4)))[: r.randint(1, 12)]
        n = len(value)
        price = {(i, j): segment_price(value, i, j, ranks) for i in range(n) for j in range(i + 1, n + 1)}
        cheapest = math.inf
        for cuts in range(1 << (n - 1)):  # every set of places to cut at
            ends = [k + 1 for k in range(n - 1) if cuts >> k & 1] + [n]
            cheapest = min(cheapest, sum(price[i, j] for i, j in zip([0, *ends], ends)))
        assert secrets.guess_cost(value, ranks) == pytest.approx(cheapest, abs=1e-9), value
    assert secrets.guess_cost("qwertyuser", ranks) == pytest.approx(secrets.guess_cost("qwerty", ranks) + secrets.guess_cost("user", ranks), abs=0.5)


def test_long_values_take_linear_time():
    begin = time.time()
    for value in ("a" * 40_000, "ab" * 20_000, "abcabd" * 7_000, "qwertyuiop" * 4_000, "qw" * 20_000, "20240131" * 5_000, "password" * 5_000):
        secrets.guess_cost(value)
    assert time.time() - begin < 40


def test_dictionary_is_that_of_the_vocabulary():
    ranks = secrets.word_ranks()
    assert len(ranks) > 20_000 and ranks["password"] == 1 and ranks["morning"] < ranks["diffuser"]
    assert pickle.loads(pickle.dumps(ranks)).longest == ranks.longest >= 20
    assert secrets.guess_cost("diffuser") < 5 < secrets.GUESS_COST < secrets.guess_cost("dxffqser")


ROWS = [(1, None, "x"), (2, "", "x"), (3, "a@b.co 1.2.3.4", "x"), (3, "a@b.co 1.2.3.4", "x"), (None, "é a@b.co", "x"), (5, "token=abcdefgh " + "0f" * 20, "x")]


def test_queries_over_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, spans string")
    got = pii.span_digest(pii.find_pii(docs), PII_KINDS).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    empty = hashlib.sha256(b"").hexdigest()
    assert by[1].base_sha256 == by[2].base_sha256 == empty and by[1].spans == ""
    assert by[3].spans == "email:0:6,ip:7:14" and (by[3].n_email, by[3].n_ip, by[3].n_card, by[3].n_phone) == (1, 1, 0, 0)
    assert by[3].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
    assert by[None].spans == "email:2:8"  # code points
    got = {r.doc_id: r for r in pii.span_digest(secrets.find_secrets(docs), SECRET_KINDS).collect()}
    assert got[5].spans == "assign:0:14,hex:15:55" and got[1].spans == ""
    assert pii.find_pii(docs.limit(0)).count() == secrets.find_secrets(docs.limit(0)).count() == 0


def test_masking_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "see a@b.co now", 14), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.mask_pii(docs).collect()}
    assert got == {1: ("see <email> now", 15), 2: (None, None), 3: ("clean", 5)}
