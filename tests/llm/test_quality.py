import random
import re
from collections import Counter

from pyspark.sql import functions as F

from seedflow.llm import quality as Q
from tests.llm.conftest import ROWS

SPACES = " \t\n\x0b\x0c\r"


def brute(text):
    t = text or ""
    words = [w for w in re.split(f"[{SPACES}]+", t) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def texts():
    rng = random.Random(2)
    out = []
    for _ in range(150):
        words = [rng.choice("abcdef") + rng.choice(["", ".", "#", "é"]) for _ in range(rng.randint(0, 80))]
        out.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\t", "\r\n"]) for w in words))
    return out + ["a " * 9, "a " * 8, "x y z " * 400]


def test_base_rules_against_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in Q.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), repr(t)


def test_line_rules(spark):
    lines = {
        "This is a plain sentence.": True, "He said “stop!”": True, "A heading without an end": False, "Home": False, "Home | News | Sport | More.": False,
        "Read more.": False, "All rights reserved.": False, "We use cookies to make this site better for all of you who read it.": False,
        "One sentence ends here. And then another one begins but it is cut in the mid": True, "a | b.": True, "Ça va bien ?": True,
        "Alle Rechte vorbehalten.": False, "Zurück": False, "Weiterlesen.": False, "Die Suche nach dem Weg zurück war lang.": True,
        "Tous droits réservés.": False, "Lire la suite...": False, "Il va lire la suite du livre.": True,
        "Todos los derechos reservados.": False, "Iniciar sesión.": False, "Al inicio no pasa nada.": True,
    }
    got = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in lines], "x string").select("x", Q.line_ok(F.col("x"))).collect()}
    assert got == lines


def test_documents_that_lose_too_much_go(spark):
    body = "\n".join(" ".join(f"word{i}{k}" for k in range(9)) + "." for i in range(6))
    rows = [(1, body, 1, "k"), (2, body + "\nAll rights reserved\nHome | About | Contact | Help", 1, None), (3, "\n".join([" ".join(f"head{i}{k}" for k in range(9)) for i in range(6)]), 1, "z"), (4, None, None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kept string")
    got = {r["doc_id"]: r for r in Q.clean_documents(docs).collect()}
    assert set(got) == {1, 2} and got[2]["text"] == body and got[2]["n_chars"] == len(body) and got[2]["kept"] is None and got[1]["kept"] == "k"


def test_odd_rows_and_plan(spark, odd, empty, sf_dir):
    rows = Q.op6_quality_rules(spark, sf_dir).collect()
    key = lambda x: (x[0] is None, *map(str, x))
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows), key=key) == sorted(((r[0], *brute(r[1])) for r in ROWS), key=key)
    assert Q.measure(empty).count() == 0
    plan = Q.measure(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and Q.clean_documents(odd).columns == odd.columns
