"""Answers against the claims that they cite: the kinds of failures, and whole answers against a reading sentence by sentence."""

import re

import regex

from tessera.operators import fidelity as F


def one(sentence, *claims, hedging="confirmed"):
    """What is wrong with a sentence that cites these texts."""
    cited = [(k, t, h) for k, (t, h) in enumerate((c if isinstance(c, tuple) else (c, hedging) for c in claims), 1)]
    return judged_one_by_one(f"{sentence} " + "".join(f"[c{k}]" for k, *_ in cited), {k: (t, h) for k, t, h in cited})


def judged_one_by_one(answer, evidence):
    """The rule, sentence by sentence: (sentence, kind, claim)."""
    has = lambda p, t: re.search(p, t, re.I)
    out = []
    for s in regex.split(F.END, answer):
        pairs = [n.split(" ") for n in regex.findall(F.NAME, regex.sub(F.MARKER, "", s))]
        pairs = [n for n in pairs if n[0] not in F.NO_FIRST and n[1] not in F.NO_SECOND]
        if not pairs:
            continue
        ids = [int(x) for x in re.findall(F.MARKER, s)]
        cited = [i for i in ids if i in evidence]
        starts = [m.start() for a, _ in F.ASSERTED if (m := has(a, s))]
        if not cited:
            if ids or starts:
                out.append((s, "identity", None))
            continue
        e = "\n".join(evidence[i][0] for i in cited)
        low, proof = e.lower(), re.sub(F.DENIED, " ", e, flags=re.I)

        def there(pair):
            last = pair[1].lower()
            near = regex.split(r"[^\p{L}'’-]+", low[max(0, low.find(last) - 30) : max(0, low.find(last))])  # noqa: B023
            return " ".join(pair).lower() in low or (len(last) >= 3 and last in low and any(len(t) > 1 and t[0] == pair[0][0].lower() for t in near))  # noqa: B023

        attributed = has(F.ATTRIBUTED, s)
        kind = None
        if not all(map(there, pairs)):
            kind = "identity"
        elif has(F.CANDIDATE, e) and has(F.STATUS_WORD, s) and starts and not has(F.CANDIDATE, s) and not has(F.SAID_OPEN, s):
            kind = "certainty"
        elif any(has(a, s) and not has(p, proof) for a, p in F.ASSERTED):
            kind = "predicate"
        elif has(F.CURRENT, s) and has(F.EXPIRED, e) and not has(F.EXPIRED, s):
            kind = "status"
        elif all(evidence[i][1] in F.HEDGED for i in cited) and starts and not (attributed and attributed.start() < min(starts)):
            kind = "certainty"
        if kind:
            out.append((s, kind, cited[0]))
    return out


def faithful_one_by_one(answer, evidence):
    failed = judged_one_by_one(answer, evidence)
    text = answer
    for s, _, claim in failed:
        said = re.sub(r"\.$", "", re.sub(r"\s+", " ", re.sub(F.MARKER, "", evidence[claim][0])).strip(" ")) if claim else None
        text = text.replace(s, f'Sources state: "{said}." [c{claim}]' if claim else "", 1)
    return (re.sub("\n{3,}", "\n\n", re.sub("[ \t]{2,}", " ", text)).strip() if failed else text), len(failed)


KINDS = [
    ("Ivan Petrov was convicted.", ["A court convicted Ivan Petrov."], None),
    ("Ivan Petrov was convicted.", ["Ivan Petrov was charged."], "predicate"),
    ("Nikolai Petrov spoke.", ["Ivan Petrov spoke."], "identity"),
    ("Aleksandr Novak spoke.", ["Alexander Novak spoke."], None),
    ("Ivan Petrov was arrested.", [("Ivan Petrov was arrested.", "claimed")], "certainty"),
    ("According to reports, Ivan Petrov was arrested.", [("Ivan Petrov was arrested.", "claimed")], None),
    ("Ivan Petrov was arrested, according to reports.", [("Ivan Petrov was arrested.", "claimed")], "certainty"),
    ("Ivan Petrov was arrested.", ["Ivan Petrov was not arrested."], "predicate"),
    ("Ivan Petrov is sanctioned.", ["Ivan Petrov was sanctioned, then delisted."], "status"),
    ("Ivan Petrov is sanctioned.", ["The former deputy minister Ivan Petrov is under sanctions."], None),
    ("Ivan Petrov is sanctioned.", ["Ivan Petrov: a possible match, sanctions."], "certainty"),
    ("The Security Council met.", ["x"], None),
]


def test_kinds(spark):
    rows = [(str(k), f"{s} " + "".join(f"[c{i}]" for i in range(1, len(c) + 1))) for k, (s, c, _) in enumerate(KINDS)]
    claims = [(str(k), i, *(x if isinstance(x, tuple) else (x, "confirmed"))) for k, (_, c, _) in enumerate(KINDS) for i, x in enumerate(c, 1)]
    said, cited = spark.createDataFrame(rows, "key string, answer string"), spark.createDataFrame(claims, "key string, claim bigint, text string, hedging string")
    found = {r.key: r.kind for r in F.judged(said, cited, "key").collect()}
    assert [found.get(str(k)) for k in range(len(KINDS))] == [kind for *_, kind in KINDS]
    assert [(one(s, *c) or [(0, None)])[0][1] for s, c, _ in KINDS] == [kind for *_, kind in KINDS]


def test_replaced_sentences(spark):
    answers = [("a", "It rained. Ivan Petrov died [c1]. Ivan Petrov died. \n\n\n\nEnd."), ("b", "Quiet.  Two spaces stay."), ("c", None), ("d", "")]
    said, cited = spark.createDataFrame(answers, "key string, answer string"), spark.createDataFrame([("a", 1, "Ivan  Petrov spoke [c7] $1.", "confirmed")], "key string, claim bigint, text string, hedging string")
    found = {r.key: (r.answer, r.replaced) for r in F.faithful(said, cited, "key").collect()}
    assert found == {"a": ('It rained. Sources state: "Ivan Petrov spoke $1." [c1] \n\nEnd.', 2), "b": ("Quiet.  Two spaces stay.", 0), "c": (None, 0), "d": ("", 0)}
    assert F.faithful(said.limit(0), cited, "key").count() == 0


def test_query(spark, sf):
    from tessera.plans import answers, registry

    said, cited = answers.cited_turns(spark, sf)
    evidence = {}
    for r in cited.collect():
        evidence.setdefault(r.key, {})[r.claim] = (r.text, r.hedging)
    want = {r.key: faithful_one_by_one(r.answer, evidence[r.key]) for r in said.collect()}
    found = {r.key: (r.answer, r.replaced) for r in registry.queries()["faithful_answers"](spark, sf).collect()}
    assert found == want and sum(n for _, n in want.values()) > 20
