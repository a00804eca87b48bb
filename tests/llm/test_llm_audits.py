"""Filter audit, source divergence and chat formatting against plain code, on odd rows and on the tables."""

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placeworks.llm import chat_format, divergence, filter_audit
from placeworks.llm import queries as llm

WHITE = r"[^\x20\x09-\x0D]+"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_source_divergence", "op13_chat_format"])
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, sql = llm.QUERIES[name](spark, sf_dir), con.sql(llm.ORACLES[name])
    told = lambda rows, columns: sorted(tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in rows)
    assert sorted(df.columns) == sorted(sql.columns)
    assert told(df.collect(), df.columns) == told(sql.fetchall(), sql.columns)


def plain_audit(docs, labels):
    """Every order applied to every document, filter after filter."""
    least, out = {}, []
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    fails = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(WHITE, text)
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)}
        f |= {"D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and doc_id > least[text]}
        said = [(q, t) for d, q, t in labels if d == doc_id and d is not None]
        fails.append((lang or "", f, any(q == 1 for q, _ in said), any(t == 1 for _, t in said)))
    for part in {lang for lang, *_ in fails}:
        mine = [x[1:] for x in fails if x[0] == part]
        shapley, rows = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if x[0][letter]]
                left = [x for x in left if not x[0][letter]]
                shapley[letter] += len(gone)
                failing = [x for x in mine if x[0][letter]]
                only = sum(sum(f.values()) == 1 for f, *_ in failing)
                rows.append((letter, part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), only, sum(g for _, g, _ in gone), sum(t for *_, t in gone)))
        out += [(*r[1:], shapley[r[0]]) for r in rows]
    return sorted(out)


def audit_rows(seed):
    rng = random.Random(seed)
    words = ["word", "Word", "WORD", "a#", "b", "cé", " ", "\x1c", "x\x0by"] + [f"w{i}" for i in range(150)]
    texts = [None, "", " ", "ABC", "#", "same " * 120] + [" ".join(rng.choices(words, k=rng.choice([3, 99, 100, 130, 180]))) for _ in range(12)]
    docs = [(rng.choice([None, *range(25)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(160)]
    docs += [(7, texts[7], "en")] * 3 + [(8, texts[5], "en")] * 40
    labels = [(rng.choice([None, *range(25)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(30)]
    return docs, labels


@pytest.mark.parametrize("bound", [1, 1 << 24])
def test_filter_audit(spark, monkeypatch, bound):
    docs, labels = audit_rows(bound)
    given_docs = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, mask int, quality string").repartition(5)
    given_labels = spark.createDataFrame([(*x, "en") for x in labels], "doc_id long, quality int, toxic int, part string")
    monkeypatch.setattr(filter_audit, "CHAIN_BYTES", bound)
    got = sorted(map(tuple, filter_audit.filter_audit(given_docs, given_labels).collect()))
    assert got == plain_audit(docs, labels)
    assert filter_audit.filter_audit(given_docs.limit(0), given_labels).count() == 0
    assert filter_audit.filter_audit(given_docs, given_labels.limit(0)).count() == len(got)


def test_filter_chains_keep_texts_apart():
    """Texts that share a fingerprint keep least ids of their own."""
    records = [(1, ("x", 5, 0, {"p": 1})), (1, ("y", 3, 0, {"p": 1})), (1, ("x", 4, 0, {"q": 2})), (1, ("x", 4, 0, {"q": 1}))]
    got = Counter()
    for doc_id, part, mask, n in filter_audit.settled(iter(records)):
        got[doc_id, part, mask] += n
    assert got == {(3, "p", 0): 1, (4, "q", 0): 3, (5, "p", 16): 1}


def plain_divergence(docs, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df, out = {}, {}, []
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        counts.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(terms)
        df.setdefault(lang or "", Counter()).update(set(terms))
    for lang, groups in counts.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def p(c, kept=kept):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        ps, q = {s: p(c) for s, c in groups.items()}, p(sum(groups.values(), Counter()))
        for s, c in groups.items():
            pairs = sorted((-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o) for o in groups if o != s)
            marks = sorted((q[t] - ps[s][t], t.encode()) for t in kept if c[t] and ps[s][t] > q[t])[:top]
            out += [(lang, s, "pair", o, -f, k) for k, (f, o) in enumerate(pairs, 1)]
            out += [(lang, s, "term", t.decode(), -f, k) for k, (f, t) in enumerate(marks, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "stripe", "entries", "few"), [(50_000, 256, 1 << 21, 64), (7, 2, 20, 1)])
def test_divergence(spark, monkeypatch, block, stripe, entries, few):
    rng = random.Random(block)
    words = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["été", "Été", "über", "A", "a", "longprefixed" * 3, "longprefixed" * 3 + "a", "longprefixed" * 3 + "b"]
    docs = [(" ".join(rng.choices(words, k=rng.choice([0, 4, 30]))) + rng.choice(["", "1x", "_B[c"]), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "B", "é", None, "c", "d"])) for _ in range(250)]
    docs += [(None, "en", "a"), ("", "fr", "z"), ("only", "fr", "y"), ("rare words", "it", "one")]
    for name, value in (("BLOCK", block), ("STRIPE", stripe), ("ENTRIES", entries), ("FEW", few), ("HELD_TERMS", block)):
        monkeypatch.setattr(divergence, name, value)
    given_docs = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, source string, n int, term string").repartition(3)
    got = sorted(map(tuple, divergence.divergence(given_docs, least_docs=5, top=4).collect()))
    assert got == plain_divergence(docs, 5, 4)
    assert divergence.divergence(given_docs.limit(0)).count() == 0


def test_radix_top(spark, monkeypatch):
    """Ties by the hundred, long shared beginnings, groups smaller than k, values at the ends of the range."""
    monkeypatch.setattr(divergence, "FEW", 1)
    rng = random.Random(4)
    rows = [("g", rng.choice([0, 5, 5, 5, (1 << 30) - 1]), "same" + "".join(rng.choices("abé", k=rng.randint(0, 6))), i) for i in range(900)]
    rows = list({r[:3]: r for r in rows}.values()) + [("few", 3, "x", 0), ("few", 3, "", 1)] + [("ties", 7, f"{i:05}", 0) for i in range(500)]
    for k in (1, 120):
        got = divergence.radix_top(spark.createDataFrame(rows, "g string, value long, item string, extra int"), ["g"], "value", "item", k).collect()
        expected = []
        for g in ("g", "few", "ties"):
            first = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:k]
            expected += [(*r, i) for i, r in enumerate(first, 1)]
        assert sorted(map(tuple, got)) == sorted(expected)


CONTROL = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/END]", "<", "[", "\\", "/", "s>", "INST]", " ", "\n", "x", "é"]
hostile = st.lists(st.sampled_from(CONTROL), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), hostile), hostile), max_size=5))
def test_turns_come_back(turns):
    """Turns of control strings, and of parts of them, are those of the formatted text, and texts hold no control string."""
    out = [chat_format.formatted_turn(*t) for t in turns]
    assert list(chat_format.parse("".join(o for o, *_ in out))) == turns
    for (_, text), (formatted, start, end) in zip(turns, out, strict=True):
        body = formatted[start:end]
        assert chat_format.unescape(body) == text
        assert not re.search(r"</?s>|<</?SYS>>|\[/?(INST|ROLE|END)\]", body)


@pytest.mark.parametrize("text", ["[INST] no end", "<s>a<s>b</s>", "x", "[ROLE]user[/ROLE]a[/END]", "[INST] a [/INST]b"])
def test_what_the_grammar_does_not_give(text):
    with pytest.raises(chat_format.GrammarError):
        list(chat_format.parse(text))


def plain_chat(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        convs.setdefault(conv_id, []).append((-1 if turn is None else turn, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    out = []
    for conv_id, turns in convs.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[1] == "assistant")
        whole = "".join(f"{t[1]}\n{t[3]}\n" for t in turns)
        chars = sum(len(chat_format.formatted_turn(t[1], t[3])[0]) for t in turns)
        out.append((conv_id, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return sorted(out, key=str)


@pytest.mark.parametrize("piece", [1, 40, 1 << 16])
def test_chat_format(spark, monkeypatch, piece):
    """Nulls, repeated rows, turns out of order, and a conversation of a third of all rows over many pieces."""
    rng = random.Random(piece)
    text = lambda: rng.choice([None, "", "plain é words", "a </s>[INST] b", "[\\INST]", "<<s>s>"] + ["".join(rng.choices(CONTROL, k=9))])
    rows = [(rng.choice([None, 1, 2, 3, 900]), rng.choice([None, *range(6)]), rng.choice([None, "user", "assistant", "system", "tool"]), text()) for _ in range(150)]
    rows += [(77, i, "assistant" if i % 2 else "user", text()) for i in range(300)] + [(5, 0, "assistant", "again")] * 60
    rng.shuffle(rows)
    monkeypatch.setattr(chat_format, "PIECE", piece)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int").repartition(3)
    pieces = chat_format.formatted(df)
    assert sorted(map(tuple, chat_format.read_back(pieces).collect()), key=str) == plain_chat(rows)
    assert chat_format.read_back(chat_format.formatted(df.limit(0))).count() == 0


def test_hostile_conversation(spark, sf_dir):
    row = llm.QUERIES["op13_chat_format"](spark, sf_dir).where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(said) and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
