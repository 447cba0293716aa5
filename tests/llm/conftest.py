import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the of and ing tion er ou th at re".split(), "fr": "eau aux ment que le oi è é re tion".split(), "de": "sch ung ein der ich keit pf ü ß en".split(), "es": "ción ado ez que ll ñ os as í ja".split()}


def words(rng: random.Random, lang: str, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng: random.Random, lang: str = "en", n: int = 120) -> str:
    w = words(rng, lang, n)
    return ". ".join(" ".join(w[i : i + 12]).capitalize() for i in range(0, n, 12)) + "."


@pytest.fixture()
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with columns that clash with what the operators use inside."""

    def make(rows):
        df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)
        return df.selectExpr("*", "1 as id", "2 as score", "'x' as th1", "3 as n", "4 as component", "'y' as key", "array(1) as spans")

    return make


#: Null and empty texts, one character, no word, a repeated row, a null id.
ODD = [(900, None, "en"), (901, "", None), (902, "a", "en"), (903, "!!! ???", "en"), (904, "Same row.", "en"), (904, "Same row.", "en"), (None, "No id here.", "en")]
