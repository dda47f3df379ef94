"""Quality rules against a loop over words and lines."""

import random
import re

from tonegrid.llm.rules import RULES, STOP_WORDS, Rule, apply_rules

SPACE = r"[\x20\x09-\x0D]+"


def measured(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
        "n_lines": len(lines), "n_capitals": sum("A" <= c <= "Z" for c in text), "n_letter_words": sum(any(c.isalpha() for c in w) for w in words),
        "n_latin_words": len(words) if len(text.encode()) * 2 < len(text) * 3 else 0, "n_stop_words": sum(w.lower() in STOP_WORDS for w in words),
        "n_bullet_lines": sum(bool(re.match(r"[ \t]*[-*•]", x)) for x in lines), "n_ellipsis_lines": sum(bool(re.search(r"(\.\.\.|…)[ \t\r]*$", x)) for x in lines),
    }


def judged(text):
    m = measured(text)
    base = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
    failed = [
        r.name for r in RULES if m["n_words"] >= r.from_words and ((r.least is not None and 100 * m[r.count] < r.least * m[r.of]) or (r.most is not None and 100 * m[r.count] > r.most * m[r.of]))
    ]
    return (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"], base, not base and not failed, failed)


def texts():
    rng = random.Random(13)
    pool = ["the", "of", "A", "été", "日本", "x1", "LOUD!!", "##", "a|b", "42", "word...", "-", "naïve", "Straße", "wow…"]
    make = lambda n: "".join(rng.choice(pool) + rng.choice([" ", " ", "  ", "\n", "\t", "\r\n", "\x0b"]) for _ in range(n))
    out = [None, "", "  \n ", "one", " ", "a b c d e", "a b c d e a b c d e", "a a a a a a", "x " * 9, "x " * 10, " ".join(map(str, range(60))), "привет мир и все тут " * 1 + " ".join("слово%s" % c for c in "абвгдежзик" * 6)]
    out += ["- one line of the list\n" * 12, "and so on...\nand on…  \nthe end of it all is near\n", "clean words stand in this text for the rule of the day and it is kept as it was"]
    out += [make(rng.randint(1, 150)) for _ in range(150)] + [make(4000), " ".join(f"{w} of the" for w in range(3000))]
    return out


def test_rules(spark):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts())]
    rows += [(None, "clean words stand in this text for the rule of the day and it is kept as it was", "x", 1, 2), rows[20], rows[20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, own int, n_words int").repartition(3)
    got = [tuple(r) for r in apply_rules(docs, ["doc_id", "words", "own", "n_words"]).collect()]
    want = [(i, w, o, *judged(t)) for i, t, w, o, _ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[-2] for r in got} == {True, False} and len({tuple(r[-1]) for r in got}) > 5
    assert {name for r in got for name in r[-1]} == {r.name for r in RULES}


def test_no_rows_no_rules_and_own_rules(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat and the dog sat on it")], "doc_id long, text string")
    assert apply_rules(docs.limit(0), ["doc_id"]).count() == 0
    (row,) = apply_rules(docs, ["doc_id"], rules=(), stop_words=("cat",)).collect()
    assert row.kept and row.failed_rules == []
    (row,) = apply_rules(docs, [], rules=(Rule("short", "n_words", "n_lines", most=1100),)).collect()
    assert not row.kept and row.failed_rules == ["short"] and not row.base_failed


def test_no_python_on_the_path(spark):
    plan = apply_rules(spark.createDataFrame([(1, "x")], "doc_id long, text string"), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
