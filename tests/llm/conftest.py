"""Small tables with every odd case: NULLs in any column, empty, blank and very
long texts, copies, near copies, ties, repeated rows, clashing extra columns."""

import random
from types import SimpleNamespace

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "host string, token long, pos int, term string, level int, unit long, count long, bucket int, `w` string")


def make_docs():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = prose(60)
    base = prose(120)
    texts = [base, base, base.upper(), prose(80), None, "", " \n\t ", "one two three", "One  two\nthree"]
    for k in range(12):  # near copies at growing distance
        w = base.split()
        for _ in range(k + 1):
            w[rnd.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    texts += [prose(30) + "\n" + passage + " " + prose(20) for _ in range(4)]
    texts += [prose(25000), ("same words here again and " * 60).strip(), "line a b\nline a b\n\nline a b\nother"]
    texts += ["mail joe.doe@example.com or +1 (555) 010-9999, card 4111 1111 1111 1111 at 10.0.0.255 " + prose(12),
              "é̀ 中文 ßäö " + prose(15), "x" * 3000, "#$% | <> & *" * 4]
    rows = [(k, t, "en" if k % 3 else None, None if k % 7 == 0 else f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    return [(*r, "h", 1, 2, None, None, 5, 6, 7, "x") for r in rows], passage


@pytest.fixture(scope="session")
def small(spark):
    rows, passage = make_docs()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    return SimpleNamespace(rows=[(r[0], r[1]) for r in rows], full=rows, docs=docs, passage=passage,
                           empty=spark.createDataFrame([], SCHEMA))
