"""Text that looks the same in one form: script-aware repair of characters.

Three steps, the first two per character, the third per token:

1. invisible characters go, wide forms become plain ones, every kind of single space becomes a space,
2. accents are composed (NFC),
3. in a token of mixed scripts the dominant script is the one that has letters of its own there (letters that look like
   no letter of another script); where all could be either, the script of most of the document. The look-alikes are
   then put into that script, if the result is a word of some document of the corpus as it stands.

A token wholly of look-alikes of a script in which the document has no word of its own (an initial, say) counts as mixed with
the script of its document; where the document has such words, it is one of them and stays. ``whole=False`` leaves all such
tokens alone. Letters that look alike only roughly, or in one fount, count in tokens of mixed scripts only.

One pass in Arrow batches over the texts yields, per document, digests of the text before and after; only texts with
suspect tokens are carried on (their words are joined to the vocabulary by shuffles, nothing is broadcast or collected).

Defined cases: NULL and empty texts have no form and form no class; texts that are equal characters are one variant;
letter case, digits, line breaks and visible accents are kept; a text of any length is read whole. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from docketry.llm.characters import fold
from docketry.session import materialise

# Letters that look like a Latin letter in common founts, in the order of the Latin letters.
CYRILLIC = dict(zip("АВСЕНІЈКМОРЅТХУаԁеһіјорԛѕѵԝху", "ABCEHIJKMOPSTXYadehijopqsvwxy", strict=True)) | {"с": "c"}
GREEK = dict(zip("ΑΒΕΗΙΚΜΝΟΡΤΧΥΖϲϳον", "ABEHIKMNOPTXYZcjov", strict=True))
ARMENIAN = dict(zip("ՕՍցհոքօսյ", "OUghnpouj", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHiJKLMPRSTVWZ", strict=True))
LISU = dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ", strict=True))
PHONETIC = dict(zip("ɑɡɩʏʟʜɴ", "agiYLHN", strict=True))
# Letters that look like a Latin one only roughly.
ROUGHLY = dict(zip("αικρυкⲟ", "aikpuko", strict=True))
#: Letters of Latin form that Unicode's data give as a variant of a plain one: mathematical founts, letter-like signs, Roman numerals.
VARIANTS = {chr(c): n for c in (*range(0x2100, 0x2180), *range(0x1D400, 0x1D800)) if (n := unicodedata.normalize("NFKC", chr(c))) != chr(c) and len(n) == 1 and n.isascii() and n.isalpha()}

#: Scripts by the first and last letter.
SCRIPTS = [("L", 0, 0x24F), ("I", 0x250, 0x2AF), ("G", 0x370, 0x3FF), ("C", 0x400, 0x52F), ("A", 0x530, 0x58F), ("K", 0x13A0, 0x13FF), ("L", 0x1E00, 0x1EFF), ("G", 0x1F00, 0x1FFF), ("V", 0x2100, 0x217F), ("G", 0x2C80, 0x2CFF), ("S", 0xA4D0, 0xA4FF), ("V", 0x1D400, 0x1D7FF)]
_SUSPECT = re.compile("[%s]" % "".join(f"{chr(a)}-{chr(b)}" for script, a, b in SCRIPTS if script != "L"))
_WORD = re.compile(r"[^\W\d_]+")
_CLEARLY = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | LISU | PHONETIC
_TO_LATIN = _CLEARLY | ROUGHLY | VARIANTS
_FROM_LATIN = {"C": {v: k for k, v in CYRILLIC.items()}, "G": {v: k for k, v in GREEK.items()}}
_LATIN_LOOKS = {c for m in _FROM_LATIN.values() for c in m}
#: Words of a task are put out, made distinct, whenever there are so many; they meet the others in a shuffle.
VOCABULARY_FLUSH = 200_000


def _script(c: str) -> str:
    o = ord(c)
    return next((script for script, a, b in SCRIPTS if a <= o <= b), "O")


def dominant_script(text: str) -> str:
    foreign = [_script(c) for c in _SUSPECT.findall(text)]
    latin = sum(c < "ɐ" and c.isalpha() for c in text)
    return max((("L", latin), ("C", foreign.count("C")), ("G", foreign.count("G"))), key=lambda x: x[1])[0]


def _own(c: str, script: str) -> bool:
    """Whether a letter looks like no letter of another script."""
    return c not in (_LATIN_LOOKS if script == "L" else _TO_LATIN)


def substitute(token: str, around: str) -> str | None:
    """``token`` in its dominant script; NULL where it is of one script already or can't be brought into one.

    A token of one script other than ``around`` counts as mixed with it if all its letters clearly look like others.
    """
    scripts = {_script(c) for c in token}
    if "O" in scripts or scripts == {"L"} or (len(scripts) == 1 and (around in scripts or not all(c in _CLEARLY for c in token))):
        return None
    own = {s for c in token if _own(c, s := _script(c))}
    if len(own) > 1:
        return None
    target = own.pop() if own else around
    if target not in "LCG":
        return None
    out = []
    for c in token:
        s = _script(c)
        latin = c if s == "L" else _TO_LATIN.get(c)
        put = c if s == target else latin if target == "L" else _FROM_LATIN[target].get(latin)
        if put is None:
            return None
        out.append(put)
    result = "".join(out)
    return None if result == token else result


def suspects(text: str, whole: bool = True) -> dict[str, str]:
    """Tokens of a folded text that may be disguised, with what they would be."""
    if text.isascii() or not _SUSPECT.search(text):
        return {}
    tokens = {t for t in set(_WORD.findall(text)) if _SUSPECT.search(t)}
    around = dominant_script(text)
    of = {t: {_script(c) for c in t} for t in tokens}
    # scripts in which the text has words of their own
    spoken = {s for t, scripts in of.items() if len(t) > 1 and len(scripts) == 1 and any(_own(c, *scripts) for c in t) for s in scripts}
    asked = (t for t, scripts in of.items() if len(scripts) > 1 or (whole and not scripts & spoken))
    return {t: r for t in asked if (r := substitute(t, around))}


def replace(text: str, words: dict[str, str]) -> str:
    return _WORD.sub(lambda m: words.get(m.group(), m.group()), text) if words else text


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


_PASS = "kind string, doc_id long, raw binary, form binary, text string, tokens array<struct<token:string,result:string>>, word string"
_ARROW = pa.schema([
    ("kind", pa.string()), ("doc_id", pa.int64()), ("raw", pa.binary()), ("form", pa.binary()), ("text", pa.string()),
    ("tokens", pa.list_(pa.struct([("token", pa.string()), ("result", pa.string())]))), ("word", pa.string()),
])


def _scan(batches: Iterator[pa.RecordBatch], whole: bool = True) -> Iterator[pa.RecordBatch]:
    words: set[str] = set()

    def rows(kind: str, **columns: list) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_pydict({f.name: pa.array(columns[f.name] if f.name in columns else [kind if f.name == "kind" else None] * n, f.type) for f in _ARROW}, schema=_ARROW)

    for batch in batches:
        ids, raw, form, texts, tokens = [], [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            folded = fold(text)
            odd = suspects(folded, whole)
            words.update(_WORD.findall(folded.lower()))
            ids.append(i)
            raw.append(_digest(text))
            form.append(None if odd else raw[-1] if folded is text else _digest(folded))
            texts.append(folded if odd else None)
            tokens.append([{"token": t, "result": r} for t, r in odd.items()] or None)
        yield rows("document", doc_id=ids, raw=raw, form=form, text=texts, tokens=tokens)
        if len(words) >= VOCABULARY_FLUSH:
            yield rows("word", word=sorted(words))
            words.clear()
    if words:
        yield rows("word", word=sorted(words))


@F.pandas_udf(BinaryType())
def _repaired_digest(text: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([_digest(replace(t, {} if w is None else {x["token"]: x["result"] for x in w})) for t, w in zip(text, tokens, strict=True)])


@F.pandas_udf(StringType())
def _repaired_text(text: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([replace(fold(t), {} if w is None else {x["token"]: x["result"] for x in w}) for t, w in zip(text, tokens, strict=True)])


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null and text <> ''")


def _approved(scanned: DataFrame) -> DataFrame:
    """``(doc_id, approved)``: per suspect document the tokens whose result is a word of the corpus."""
    odd = scanned.filter("kind = 'document' and tokens is not null").select("doc_id", F.explode("tokens").alias("t")).select("doc_id", "t.token", "t.result", F.lower("t.result").alias("word"))
    words = odd.select("word").distinct().join(scanned.filter("kind = 'word'").select("word").distinct(), "word", "left_semi")
    return odd.join(words, "word", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("token", "result")).alias("approved"))


def forms(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """``(doc_id, raw, form)``: 128-bit digests of every text as it is and in its one form."""
    scanned = materialise(_texts(documents, doc_id, text).mapInArrow(lambda batches: _scan(batches, whole), _PASS), partition_by="kind")
    docs = scanned.filter("kind = 'document'")
    odd = docs.filter("tokens is not null").join(_approved(scanned), "doc_id", "left").select("doc_id", "raw", _repaired_digest("text", "approved").alias("form"))
    return docs.filter("tokens is null").select("doc_id", "raw", "form").unionByName(odd)


def repair(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """``(doc_id, text)`` with every text in its one form."""
    texts = _texts(documents, doc_id, text)
    scanned = materialise(texts.mapInArrow(lambda batches: _scan(batches, whole), _PASS), partition_by="kind")
    plain = F.octet_length("text") == F.length("text")
    others = texts.filter(~plain).join(_approved(scanned), "doc_id", "left").select("doc_id", _repaired_text("text", "approved").alias("text"))
    return texts.filter(plain).unionByName(others)


def classes(formed: DataFrame) -> DataFrame:
    """``(doc_id, class_id, variant_id)`` of documents in a class with two variants or more; ids are the smallest doc_id."""
    split = formed.groupBy("form").agg(F.min("raw").alias("a"), F.max("raw").alias("b"), F.min("doc_id").alias("class_id")).filter("a <> b").select("form", "class_id")
    members = formed.join(split, "form")
    variants = members.groupBy("form", "raw").agg(F.min("doc_id").alias("variant_id"))
    return members.join(variants, ["form", "raw"]).select("doc_id", "class_id", "variant_id")


def pairs(members: DataFrame) -> DataFrame:
    """``(doc_id_a, doc_id_b)``, the smaller first, of documents of one class and different variants."""
    a = members.select(F.col("doc_id").alias("doc_id_a"), "class_id", F.col("variant_id").alias("va"))
    b = members.select(F.col("doc_id").alias("doc_id_b"), "class_id", F.col("variant_id").alias("vb"))
    return a.join(b, "class_id").filter("va <> vb and doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
