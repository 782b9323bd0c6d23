"""Fields of scanned documents from positioned tokens: lines by gaps, text, kind, labels and the values after them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import detectors as D

GAP = 10.0


def lines(tokens: DataFrame, keys: tuple[str, ...] = ("doc",), gap: float = GAP) -> DataFrame:
    """Tokens (x, y, w, h, word, ord) with ``line``: a new one where y steps by more than ``gap`` from the token before.

    Order is by y and x; a comparator with a tolerance has no consistent order, so this is the defined one.
    """
    by = W.partitionBy(*keys).orderBy("y", "x", "ord")
    step = F.coalesce((F.col("y") - F.lag("y").over(by) > gap).cast("int"), F.lit(0))
    return tokens.withColumn("_s", step).withColumn("line", F.sum("_s").over(by)).drop("_s")


def line_texts(tokens: DataFrame, keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    """keys, line, text, x, y, w, h: the words of a line from the left, and the box around them."""
    sort = F.array_sort(F.collect_list(F.struct("x", "ord", "word")))
    out = tokens.groupBy(*keys, "line").agg(
        F.array_join(F.transform(sort, lambda t: t["word"]), " ").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
    )
    return out


def texts(lines_: DataFrame, keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("line", "text")))
    return lines_.groupBy(*keys).agg(F.array_join(F.transform(own, lambda t: t["text"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_lines"))


_word = lambda p: rf"(?<!\w)(?:{p})(?!\w)"
#: Fixed: what tells the kinds of documents, in order, over the lower-case text of all lines.
KINDS: tuple[tuple[str, str], ...] = (
    ("ID_CARD", "|".join((
        _word(r"income\s*tax|government\s*of\s*india|govt\s*of\s*india|permanent\s*account|pan\s*card|pan\s*no|pan\s*number|incometax|aayakar"),
        _word(r"father'?s?\s*name|date\s*of\s*birth"), _word(r"uidai|unique\s*identification"), _word(r"driving\s*licence|passport|voter\s*id|epic"),
        _word(r"[a-z]{5}[\s\-]?[0-9oil]{4}[\s\-]?[a-z]")))),
    ("BANK_STATEMENT", _word(r"account\s*statement|bank\s*statement|transaction|ifsc|account\s*number|balance")),
    ("CERTIFICATE", _word(r"certificate|certify|awarded|issued|graduation|degree|diploma")),
    ("FORM", _word(r"application|form|registration|enrollment|submit|applicant")),
)


def kind(text: Column, n_lines: Column) -> Column:
    """The first kind whose words occur; a form needs more than five lines besides."""
    low = F.lower(F.regexp_replace(text, "\n", " "))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in KINDS:
        out = out.when(low.rlike(pattern) & (n_lines > 5 if name == "FORM" else F.lit(True)), name)
    return out.otherwise("UNKNOWN")


def look_ahead(lines_: DataFrame, keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    """With ``next1`` and ``next2``: the texts of the two lines after."""
    by = W.partitionBy(*keys).orderBy("line")
    return lines_.withColumn("next1", F.lead("text", 1).over(by)).withColumn("next2", F.lead("text", 2).over(by))


#: Fixed: words that label a field, with usual misreadings.
LABELS: dict[str, str] = {
    "PAN": r"pan|permanent\s+account|pan\s*card|pan\s*no|pan\s*number",
    "AADHAAR": r"aadhaar|aadhar|uid|uidai|aadhaar\s*no|aadhaar\s*number",
    "NAME": r"name|full\s*name|card\s*holder|holder\s*name|applicant|nam|nawe|nane|nan",
    "FATHER_NAME": r"father|father's\s*name|father\s*name|guardian|faber|fater|fether",
    "DOB": r"dob|date\s*of\s*birth|birth\s*date|born|d\.o\.b|dare\s*of\s*birth",
    "ADDRESS": r"address|residence|residential|location|city|state|pin|pincode",
    "PHONE": r"phone|mobile|contact|tel|telephone",
    "EMAIL": r"email|e-mail|mail",
    "SIGNATURE": r"signature|sign|signed",
}
_LABEL = {k: re.compile(rf"\b(?:{v})\b", re.I | re.A) for k, v in LABELS.items()}
#: Fixed: shapes of values; letters of a number's digits may be misread.
_PANS = [re.compile(p, re.I | re.A) for p in (r"\b([A-Z]{3}[PCHFATBLJG][A-Z][\s\-]?[0-9A-Z]{4}[\s\-]?[A-Z])\b", r"\b([A-Z]{5}[\s\-]?[0-9A-Z]{4}[\s\-]?[A-Z])\b", r"([A-Z]{3}[PCHFATBLJG][A-Z][\s\-]?[0-9A-Z]{4}[\s\-]?[A-Z])")]
_PAN_VALID, _PAN_PLAIN = re.compile(r"[A-Z]{3}[PCHFATBLJG][A-Z]\d{4}[A-Z]", re.A), re.compile(r"\b[A-Z]{5}[\s\-]?\d{4}[\s\-]?[A-Z]\b", re.I | re.A)
_AADHAAR, _DATE = re.compile(r"\b[2-9]\d{3}[\s\-]?\d{4}[\s\-]?\d{4}\b", re.A), re.compile(r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b", re.A)
_NAME_WORD = re.compile(r"[A-Z][A-Za-z]{1,15}")
#: Fixed: words of headers, which are no names.
_HEADER = re.compile(r"\b(?:INCOME|TAX|DEPARTMENT|GOVT|GOVERNMENT|OF|INDIA|ACCOUNT|NUMBER|CARD|PERMANENT|SIGNATURE|DATE|BIRTH|FATHER|NAME)\b", re.I | re.A)
_DIGITS = str.maketrans("OQILZSB", "0011258")


def pan_of(text: str) -> str | None:
    """The repaired PAN of a line, if the first shape that occurs holds a valid one."""
    found = next((m for m in (p.search(text) for p in _PANS) if m), None)
    if found is None:
        return None
    clean = re.sub("[^A-Za-z0-9]", "", found[1]).upper()
    own = clean[:5] + clean[5:9].translate(_DIGITS) + clean[9:]
    return own if _PAN_VALID.fullmatch(own) else None


class _Sheet:
    """A document's lines, each a list of words, and the fields found so far as (line, field, category, confidence, rule)."""

    def __init__(self, lines_: list[list[str]], kind_: str):
        self.lines, self.text, self.kind = lines_, [" ".join(w) for w in lines_], kind_
        self.found: list[tuple[int, str, str, float, str]] = []
        self.values: list[str | None] = []

    def has(self, name: str) -> bool:
        return any(f[1] == name for f in self.found)

    def add(self, line: int, name: str, category: str, confidence: float, rule: str, value: str | None = None) -> bool:
        self.found.append((line, name, category, confidence, rule))
        self.values.append(value)
        return True

    def after(self, i: int) -> range:
        """The two lines below."""
        return range(i + 1, min(i + 3, len(self.lines)))

    def pan(self, i: int) -> bool:
        if pan_of(self.text[i]):
            return self.add(i, "PAN", "GOV_ID", 0.99, "pan_line")
        below = next((j for j in self.after(i) if pan_of(self.text[j])), None) if _LABEL["PAN"].search(self.text[i]) else None
        return below is not None and self.add(below, "PAN", "GOV_ID", 0.99, "pan_below_label")

    def aadhaar(self, i: int) -> bool:
        return bool(_AADHAAR.search(self.text[i])) and self.add(i, "AADHAAR", "GOV_ID", 0.95, "aadhaar_line")

    def person(self, i: int, name: str, stops: tuple[str, ...]) -> bool:
        """The words after a label in its line, else the first line below that is no other label's."""
        is_label = lambda w: _LABEL[name].search(w) or (name == "FATHER_NAME" and w.lower() == "name:")
        first = next((k for k, w in enumerate(self.lines[i]) if is_label(w)), len(self.lines[i]))
        own = [w for w in self.lines[i][first:] if not is_label(w) and w.strip() and w not in (":", "-", "/")]
        line = i
        if not own:
            other = lambda t: any(_LABEL[s].search(t) for s in stops) or _PAN_PLAIN.search(t)
            line = next((j for j in self.after(i) if len(self.text[j].strip()) > 2 and not other(self.text[j])), None)
            own = [] if line is None else self.lines[line]
        return bool(own) and self.add(line, name, "PERSON", 0.88, "after_label", " ".join(own))

    def birth(self, i: int) -> bool:
        labelled = _LABEL["DOB"].search(self.text[i])
        if _DATE.search(self.text[i]):
            return bool(labelled or self.kind == "ID_CARD") and self.add(i, "DOB", "DOB", 0.90, "date_line")
        if labelled:
            below = next((j for j in self.after(i) if _DATE.search(self.text[j])), None)
            if below is not None:
                self.add(below, "DOB", "DOB", 0.90, "date_below_label")
        return False

    def line(self, i: int) -> bool:
        """One line's own field; True where the detectors have nothing to add."""
        if self.pan(i) or self.aadhaar(i):
            return True
        father = _LABEL["FATHER_NAME"].search(self.text[i])
        if _LABEL["NAME"].search(self.text[i]) and not father and self.person(i, "NAME", ("FATHER_NAME", "DOB", "PAN")):
            return True
        if father and self.person(i, "FATHER_NAME", ("DOB", "PAN")):
            return True
        return self.birth(i)

    def capitals(self) -> None:
        """On cards the first line of two to four capitalised words is the holder's name, the next other one the father's."""
        for i, text in enumerate(self.text):
            bare = re.sub(r"^[|:;\-_.]+\s*", "", text.strip())
            own = [w for w in bare.split() if _NAME_WORD.fullmatch(w)]
            clean = " ".join(own)
            if _HEADER.search(clean) or not 2 <= len(own) <= 4 or len(clean) < 6:
                continue
            if not self.has("NAME"):
                self.add(i, "NAME", "PERSON", 0.92, "capitals", clean)
            elif not self.has("FATHER_NAME") and clean not in self.values:
                self.add(i, "FATHER_NAME", "PERSON", 0.90, "capitals", clean)


def sheet_fields(lines_: list[list[str]], kind_: str, candidates: list[list[tuple[str, str, float]]] | None = None) -> list[tuple[int, str, str, float, str]]:
    """(line, field, category, confidence, rule) of a document's lines in order of finding.

    ``candidates``: what the detectors found in each line, as (subtype, category, confidence); a subtype that is
    there already isn't added again.
    """
    sheet = _Sheet(lines_, kind_)
    for i, text in enumerate(sheet.text):
        if len(text.strip()) < 3 or kind_ in ("ID_CARD", "UNKNOWN") and sheet.line(i):
            continue
        for subtype, category, confidence in candidates[i] if candidates else ():
            if not sheet.has(subtype):
                sheet.add(i, subtype, category, confidence, "detector")
    if not sheet.has("PAN"):
        at = next((i for i, text in enumerate(sheet.text) if pan_of(text)), None)
        if at is not None:
            sheet.add(at, "PAN", "GOV_ID", 0.98, "pan_anywhere")
    if (kind_ == "ID_CARD" or sheet.has("PAN")) and not (sheet.has("NAME") and sheet.has("FATHER_NAME")):
        sheet.capitals()
    return sheet.found


def fields_of(own: list[str], kind_: str = "UNKNOWN") -> list[tuple[int, str, str, float]]:
    """(line, field, category, confidence) of plain lines, without detectors.

    A value below a label counts from the label's line and again from its own.
    """
    return [f[:4] for f in sheet_fields([t.split(" ") for t in own], kind_)]


def fields(lines_: DataFrame) -> DataFrame:
    """doc, idx, line, field, category, confidence, rule, id, token of line texts (doc, line, text).

    What a line gives depends on those before, so a document's lines are read in order, many documents to a Python
    batch; a document is bounded by its sheet.  The detectors run before as expressions over each line, with the
    whole text around it.
    """
    import pyarrow as pa

    whole = texts(lines_).select("doc", F.col("text").alias("_all"), kind(F.col("text"), F.col("n_lines")).alias("kind"))
    found = F.transform(D.text_candidates(F.col("text"), F.col("_all"), at=False), lambda c: F.struct(c["subtype"].alias("s"), c["category"].alias("c"), c["confidence"].alias("f")))
    own = lines_.select("doc", "line", "text").join(whole, "doc").select("doc", "kind", F.struct("line", "text", found.alias("found")).alias("l"))
    sheets = own.groupBy("doc", "kind").agg(F.array_sort(F.collect_list("l")).alias("lines"))
    names = ["doc", "idx", "line", "field", "category", "confidence", "rule"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, kind_, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                got = sheet_fields([x["text"].split(" ") for x in own], kind_, [[(c["s"], c["c"], c["f"]) for c in x["found"]] for x in own])
                rows += [(doc, k, own[i]["line"], *rest) for k, (i, *rest) in enumerate(got)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

    out = sheets.mapInArrow(run, "doc long, idx int, line long, field string, category string, confidence double, rule string")
    id_ = F.concat_ws("_", F.lit("doc_field"), F.lower("field"), F.col("doc").cast("string"), F.col("idx").cast("string"))
    return out.withColumn("id", id_).withColumn("token", F.concat(F.lit("<REDACTED_"), "field", F.lit(">")))


def confidences(lines_: DataFrame) -> DataFrame:
    """doc, confidence (the mean over its fields, 0 without any), fields: one row per document."""
    own = fields(lines_).groupBy("doc").agg(F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("fields"))
    return lines_.select("doc").distinct().join(own, "doc", "left").select("doc", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("fields", F.lit(0)).alias("fields"))


def unnest_ocr(pages: DataFrame, least: float = 25) -> DataFrame:
    """Words of nested recognition output (blocks > paragraphs > lines > words), corners to sides, sure ones only."""
    out = pages.select("doc", F.explode("blocks").alias("b")).select("doc", F.explode("b.paragraphs").alias("p")).select("doc", F.explode("p.lines").alias("l")).select("doc", F.explode("l.words").alias("t"))
    return out.where(F.col("t.confidence") >= least).select("doc", "t.word", F.col("t.x0").alias("x"), F.col("t.y0").alias("y"), (F.col("t.x1") - F.col("t.x0")).alias("w"), (F.col("t.y1") - F.col("t.y0")).alias("h"), (F.col("t.confidence") / 100).alias("confidence"))
