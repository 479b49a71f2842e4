"""Base spans against Python's re; disclosure against a plain count over lines; sanitised texts."""

import hashlib
import math
import random
import re

import pytest
import regex

from cadenza.llm import disclosure as ds

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


TERM = regex.compile(ds.TERM)


def entities_of(line):
    for kind, pattern in zip(ds.KINDS, (EMAIL, IP, CARD, PHONE)):
        cuts = [m.span() for m in pattern.finditer(line)]
        for i, (start, end) in enumerate(cuts):
            value = line[start:end]
            if (kind, start, end) not in plain_base(line):
                continue
            before = TERM.findall(line[cuts[i - 1][1] if i else 0 : start].lower())
            after = TERM.findall(line[end : cuts[i + 1][0] if i + 1 < len(cuts) else len(line)].lower())
            name = re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower()
            yield f"{kind}:{name}", before, after


def plain_disclosures(texts, reach=ds.REACH, support=ds.SUPPORT):
    lines = {line for t in texts for line in (t or "").split("\n") if line}
    entity_lines, both, contexts, term_lines = {}, {}, {}, {}
    for line in lines:
        for term in set(TERM.findall(line.lower())):
            term_lines[term] = term_lines.get(term, 0) + 1
        for entity, before, after in entities_of(line):
            entity_lines.setdefault(entity, set()).add(line)
            for side, chosen in ((before, range(max(0, len(before) - reach), len(before))), (after, range(min(reach, len(after))))):
                for i in chosen:
                    around = (side[i - 1] if i else "", side[i + 1] if i + 1 < len(side) else "")
                    both.setdefault((entity, side[i]), set()).add(line)
                    contexts.setdefault((entity, side[i]), set()).add(around)
    best = {}
    for (entity, term), met in both.items():
        information = math.log2(len(lines) / len(entity_lines[entity]))
        # What a match cuts out of a longer term may be no term of any line.
        if len(contexts[entity, term]) >= support and information > 0 and term in term_lines:
            pmi = math.log2(len(met) * len(lines) / (len(entity_lines[entity]) * term_lines[term]))
            if pmi / information >= ds.GENERALISE:
                best[term] = max(best.get(term, (-1, "")), (pmi / information, entity))
    return {t: "remove" if s >= ds.REMOVE else "generalise" for t, (s, _) in best.items()}


def plain(rows, **more):
    told = plain_disclosures([t for _, t in rows], **more)
    out = []
    for key, text in rows:
        base = plain_base(text or "")
        spans = list(base)
        for kind in ds.MORE_KINDS:
            for m in TERM.finditer(text or ""):
                a, b = m.span()
                if told.get(m.group().lower()) == kind and not any(s < b and a < e for _, s, e in base):
                    spans.append((kind, a, b))
        join = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        count = tuple(sum(k == kind for k, _, _ in base) for kind in ds.KINDS)
        out.append((key, *count, hashlib.sha256(join(base).encode()).hexdigest(), join(spans)))
    return sorted(out, key=repr)


def found(docs, **more):
    rows = ds.report(ds.find_personal_data(docs, **more)).collect()
    columns = ["doc_id", *(f"n_{k}" for k in ds.KINDS), "base_sha256", "spans"]
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def frame_of(spark, rows):
    # Columns whose names clash with those the operator uses.
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "doc_id long, text string, key int, name int, spans int, body string").repartition(3)


ODD = [
    "a@b.c_d@e.f", "a@b@c.d", "x@y", "@a.b", "one.two@mail.example.com, +a@b-c.d.", "a@b.c@d.e", "%@-.-", "aa@b..c a@b.c.",
    "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255 0001.002.3.0 1.2.3 1..2.3.4", "999.1.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 and 4111111111111112", "4111  1111 1111 1111 1111", "1" * 20, "4111 1111 1111 1111\n4111111111111111",
    "+1 (017) 555-7713", "+1 2", "+12345678", "+1234567", "+1 (2) 3456789 )(", "++1 234 567 8901", "+123456789012345678",
    "Ünï +49 170 1234567 \U0001f600 a@b.de", "\U0001f600\U0001f600 10.0.0.1", "", " \n\n", None,
]


def test_odd_texts(spark):
    rows = [*enumerate(ODD), (0, "other text 1.1.1.1"), (0, ODD[0]), (None, "+1 (017) 555-7713"), (None, None), (None, "+1 (017) 555-7713")]
    assert found(frame_of(spark, rows)) == plain(rows)
    assert found(frame_of(spark, rows).limit(0)) == []


def test_random_texts(spark):
    rng = random.Random(3)
    pieces = ["a", "b1", "@", ".", "-", "+", " ", "(", ")", "12", "7", "255", "256", "_", "%", "\n", "é", "4111111111111111", "com"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(60)))) for i in range(800)]
    assert found(frame_of(spark, rows)) == plain(rows)


def test_very_long_runs(spark):
    rows = [(1, "a" * 300_000 + "@b.c"), (2, "1" * 200_000), (3, "1 " * 100_000), (4, "a@" + "b." * 100_000 + "c"), (5, "+1" + " " * 200_000), (6, "." * 200_000 + "@"), (7, "x@y.z " * 20_000)]
    got = {r[0]: r for r in found(frame_of(spark, rows))}
    assert [got[i][1] for i in range(1, 8)] == [1, 0, 0, 1, 0, 0, 20_000]
    assert got[7][-1].endswith(f"email:{19_999 * 6}:{19_999 * 6 + 5}") and got[4][-1] == f"email:0:{2 + 200_000 + 1}"


def people(n=400):
    """Invented lines; one name is beside one number in varied sentences, another only in copies."""
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "l")]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5, 12)))
    rows = [(i, "\n".join(line() for _ in range(4))) for i in range(n)]
    for i in range(6):
        rows.append((1000 + i, f"{line()}\n{line()} Zebulon-{'x' * 0}Quist {line().split()[0]} +1 (017) 555-7713 {line()}"))
        rows.append((1100 + i, f"{rng.choice(words)} Often {rng.choice(words)} 10.1.2.3 {rng.choice(words)}"))
        rows.append((1200 + i, "copied Singular words a@b.com in a line"))
    rows += [(1300 + i, f"{line()} often {line()}") for i in range(5)]
    rows += [(1400, "Quist alone, zebulon-quist! and Zebulon"), (1401, None)]
    return rows


def test_disclosure(spark):
    rows = people()
    docs = frame_of(spark, rows)
    told = plain_disclosures([t for _, t in rows])
    got = {r["term"]: r for r in ds.disclosures(ds.texts_of(docs, "doc_id", "text")).collect()}
    assert {t: r["action"] for t, r in got.items()} == told
    # A name beside one number is found; words that copies or chance put there are not.
    assert told["zebulon-quist"] == "remove" and told["often"] == "generalise" and set(told) == {"zebulon-quist", "often"}
    assert got["zebulon-quist"]["entity"] == "phone:10175557713" and 0.95 <= got["zebulon-quist"]["share"] <= 1 + 1e-9
    assert found(docs) == plain(rows)


def test_sanitise(spark):
    docs = frame_of(spark, people())
    made = {r["doc_id"]: r["text"] for r in ds.sanitise(docs).collect()}
    texts = dict(people())
    assert made[1400] == "Quist alone, ! and Zebulon" and made[1401] is None
    assert made[1200] == "copied Singular words <EMAIL> in a line"
    assert " <PHONE> " in made[1000] and "uist" not in made[1000] and "<NAME>" in made[1100] and "<IP>" in made[1100]
    assert "<WORD>" in made[1300] and made[0] == texts[0] and len(made) == len(texts)


def test_whole_documents(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert found(documents) == plain(rows)


def test_native_plan(documents):
    plan = ds.report(ds.find_personal_data(documents))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
