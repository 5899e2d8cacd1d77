import random
import unicodedata

import pyarrow as pa

from askweave.llm.textform import INVISIBLE, LOOKALIKES, consistent, normalise, odd_texts


def test_composes_as_nfkc():
    """Without look-alikes and invisible characters the form is NFKC with plain spaces."""
    r = random.Random(3)
    skip = {c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and len(x := unicodedata.normalize("NFKD", chr(c))) > 1 and x[0] == " "}
    skip |= set(INVISIBLE) | set(map(ord, LOOKALIKES)) | set(range(0xD800, 0xE000))
    pools = [range(0x20, 0x250), range(0x300, 0x370), [*range(0x1100, 0x1200), *range(0xAC00, 0xAC80)], range(0x900, 0xA00), range(0xF900, 0x10000), range(0x1D400, 0x1D500), range(0xB80, 0xD80)]
    texts = []
    for _ in range(8000):
        own = r.choice(pools)
        texts.append("".join(chr(c) for _ in range(r.randint(0, 12)) if (c := r.choice(r.choice([own, pools[0], pools[1]]))) not in skip))
    texts += [None, "", "a" + "̣́" * 500, "x" * 100_000 + "Ａ"]
    got, _ = consistent(pa.array(texts, pa.string()))
    for t, g in zip(texts, got.to_pylist()):
        assert g == (None if t is None else unicodedata.normalize("NFKC", "".join(" " if unicodedata.category(c) == "Zs" else c for c in t)))


def test_odd_characters(spark):
    texts = {
        1: "plain ascii", 2: "Ｆｉｎｄ it", 3: "été", 4: "zero​width", 5: "soft­hyphen", 6: "no break", 7: "cоde", 8: "Kelvin", 9: "ﬁnd",
        10: "été ‘quoted’ —", 11: "Фукиту", 12: None, 13: "", 14: "tab\tnew\nline", 15: "оса", 16: "m² ™ 5В", 17: "B7А",
    }
    rows = [(k, v, 0, "x") for k, v in texts.items()] + [(2, texts[2], 1, "y")]
    df = spark.createDataFrame(rows, "id long, t string, form int, n_wide string")
    assert {r[0] for r in odd_texts(df, "id", "t").collect()} == {2, 3, 4, 5, 6, 7, 8, 9, 17}
    forms = {r["id"]: r["form"] for r in normalise(df, "id", "t").collect()}
    assert (forms[2], forms[3], forms[4], forms[6], forms[7], forms[8], forms[9], forms[12], forms[13]) == ("Find it", "été", "zerowidth", "no break", "code", "Kelvin", "find", None, "")
    assert forms[10] == texts[10] and forms[11] == texts[11] and forms[14] == texts[14] and forms[15] == texts[15]
    assert normalise(df, "id", "t").count() == len(rows)
    assert odd_texts(df.limit(0), "id", "t").count() == 0
