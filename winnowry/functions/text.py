"""Text repair and measuring as column expressions; Python only where no expression will do."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: What Python calls white space; other engines' \\s differ among themselves.
SPACE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


_ENDS = "".join(chr(i) for i in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_ENDS))


#: Runs of white space that are more than one blank.
_RUN = re.compile(r" \s+|[^\S ]\s*")


@pandas_udf(StringType())
def normalize_whitespace(s: pd.Series) -> pd.Series:
    """Runs of white space with a line break become one line feed, others one blank."""
    return s.map(lambda t: _RUN.sub(lambda m: "\n" if "\n" in m[0] or "\r" in m[0] else " ", t), na_action="ignore")


def plain(c: Column) -> Column:
    """Surely words between single blanks: no other white space, none at the ends. Such a line is told by one look at it and needs no rewriting."""
    return (c != "") & ~c.contains("  ") & ~c.startswith(" ") & ~c.endswith(" ") & ~c.rlike("[^ -~\\xA1-\\x{167F}\\x{2010}-\\x{2027}\\x{3001}-\\x{10FFFF}]")


def one_line(c: Column) -> Column:
    """Stripped, all runs of white space one blank."""
    return F.when(plain(c), c).otherwise(_joined(c))


def squeezed(c: Column) -> Column:
    """normalize_whitespace(strip(c)), in time that grows with the text's length whatever it holds."""
    cut = F.transform(F.split(c, "[\\n\\r]+"), _joined)
    return F.when(plain(c), c).when(~c.contains("\n") & ~c.contains("\r"), _joined(c)).otherwise(F.array_join(F.filter(cut, lambda x: x != ""), "\n"))


def _runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[^{SPACE}]+"), F.lit(0))


def _joined(c: Column) -> Column:
    return F.array_join(_runs(c), " ")


def is_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(f"^[{SPACE}]*$")


def words(c: Column) -> Column:
    return F.when(plain(c), F.split(c, " ")).otherwise(_runs(c))


def escape_angle_emails(c: Column) -> Column:
    return F.regexp_replace(c, "<([\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+)>", "&lt;$1&gt;")


def clean_wiki_markup(c: Column) -> Column:
    """Templates (three levels), links, bold and italic marks and headings of wiki sources, where there are any."""
    out = c
    for _ in range(3):
        out = F.regexp_replace(out, "\\{\\{[^{}]*\\}\\}", "")
    for pattern, put in (
        ("\\[\\[(?:[^\\[\\]|]*\\|)?([^\\[\\]]*)\\]\\]", "$1"),
        ("\\[https?://[^\\s\\]]+\\s+([^\\]]+)\\]", "$1"),
        ("'{2,5}", ""),
        ("(?m)^=+\\s*(.+?)\\s*=+\\s*$", "$1"),
    ):
        out = F.regexp_replace(out, pattern, put)
    return F.when(c.contains("[[") | c.contains("{{"), out).otherwise(c)


def xml_safe(c: Column) -> Column:
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]", "")


def clean_forum_date(c: Column) -> Column:
    return F.btrim(F.regexp_replace(one_line(c), "([0-9])(?:st|nd|rd|th)\\b", "$1"), F.lit(" ,"))


def js_unescape(c: Column) -> Column:
    out = c
    for old, new in (("\\'", "'"), ('\\"', '"'), ("\\/", "/"), ("\\r", ""), ("\\n", "\n")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def clean_ocr_text(c: Column) -> Column:
    out = F.regexp_replace(c, "[\\x{E000}-\\x{F8FF}]+", "\n\n")
    return F.regexp_replace(F.regexp_replace(out, "[\\x00-\\x08\\x0B-\\x1F]", ""), "\\n{3,}", "\n\n")


MOJIBAKE = "[\\xC2\\xC3][\\x80-\\xBF]|\\xE2\\x{20AC}|\\xE2\\x80|\\xF0\\x9F|\\x{0192}\\xC2"


def one_byte(ch: str) -> int:
    """The byte that a character stands for in Windows-1252, or in Latin-1 where that has none."""
    try:
        return ch.encode("cp1252")[0]
    except UnicodeEncodeError:
        return ord(ch)


#: Characters that may be the second and later bytes of a UTF-8 sequence.
_LATER = "".join({chr(b) for b in range(0x80, 0xC0)} | {bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xC0)})
# each pattern begins with one set, by which a search passes over all other letters at once
_SEQUENCE = re.compile(f"[\u00c2-\u00f4](?:(?<=[\u00c2-\u00df])[{_LATER}]|(?<=[\u00e0-\u00ef])[{_LATER}]{{2}}|(?<=[\u00f0-\u00f4])[{_LATER}]{{3}})")
_BROKEN = re.compile("[\u00c2\u00c3\u00e2\u00f0](?:(?<=[\u00c2\u00c3])[\u0080-\u00bf\u0192]|(?<=\u00e2)[\u20ac\u0080]|(?<=\u00f0)[\u0178\u009f]|(?<=\u00c3)[\u0152-\u2122])")


def _decoded(m: re.Match) -> str:
    try:
        return bytes(map(one_byte, m[0])).decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def fix_mojibake(text: str | None) -> str | None:
    """UTF-8 that was read in a one-byte encoding, up to twice over, read as UTF-8; each sequence by itself, so other characters don't hinder it."""
    if not text or text.isascii() or not _BROKEN.search(text):
        return text
    for _ in range(2):
        new = _SEQUENCE.sub(_decoded, text)
        if new == text:
            break
        text = new
    return text


@pandas_udf(StringType())
def repair_mojibake(s: pd.Series) -> pd.Series:
    return s.map(fix_mojibake, na_action="ignore")


ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]+);")


@pandas_udf(StringType())
def decode_double_entities(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unescape(t) if ENTITY.search(t) else t, na_action="ignore")


CHARSET = re.compile(rb"<meta[^>]{1,200}?charset\s*=\s*[\"']?\s*([a-zA-Z0-9_:.-]+)", re.I)


class DecodeError(ValueError):
    """Bytes that no given encoding reads."""


def decode_bytes(raw: bytes | str | None, encoding: str | None = None, default: str = "utf8", errors: str = "replace") -> str | None:
    """Forced encoding, else the page's own charset if it's a known one, else UTF-8, else the default."""
    if raw is None or isinstance(raw, str):
        return raw
    if encoding:
        return raw.decode(encoding, errors)
    m = CHARSET.search(raw)
    if m:
        try:
            return raw.decode(m[1].decode("ascii"), errors)
        except LookupError:
            pass
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        try:
            return raw.decode(default, errors)
        except UnicodeDecodeError as e:
            raise DecodeError(f"not {default}") from e


def decode_html(c: Column, encoding: str | None = None, default: str = "utf8", errors: str = "replace") -> Column:
    @pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: decode_bytes(bytes(b), encoding, default, errors), na_action="ignore")

    return run(c)


MACROS = dict(zip("alpha beta gamma delta epsilon theta lambda mu pi rho sigma tau phi omega Gamma Delta Sigma Omega infty leq geq neq times cdot pm approx equiv to rightarrow leftarrow in subset cup cap forall exists partial nabla sum prod int ldots cdots dots".split(), "α β γ δ ε θ λ μ π ρ σ τ φ ω Γ Δ Σ Ω ∞ ≤ ≥ ≠ × · ± ≈ ≡ → → ← ∈ ⊂ ∪ ∩ ∀ ∃ ∂ ∇ ∑ ∏ ∫ … … …".split(), strict=True))
POWERS = str.maketrans("0123456789+-n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿ")


def latex_text(tex: str | None) -> str | None:
    """A formula as plain text: fractions and roots in line, symbols as characters, other macros dropped."""
    if tex is None:
        return None
    t = tex.strip().strip("$")
    t = re.sub(r"\\(?:mathrm|mathbf|mathit|mathcal|mathbb|text|textbf|operatorname)\s*\{([^{}]*)\}", r"\1", t)
    for _ in range(4 if "frac" in t else 0):
        t = re.sub(r"\\d?t?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"(\1)/(\2)", t)
    t = re.sub(r"\\sqrt\s*\{([^{}]*)\}", r"√(\1)", t)
    t = re.sub(r"\\(?:left|right)(?![a-zA-Z])", "", t)
    t = re.sub(r"\\([a-zA-Z]+)", lambda m: MACROS.get(m[1], m[0]), t)
    t = re.sub(r"\^\{?([0-9n+-]+)\}?", lambda m: m[1].translate(POWERS), t)
    t = re.sub(r"\\[a-zA-Z]+|[{}\\]", " ", t)
    return " ".join(t.split())


@pandas_udf(StringType())
def latex_to_text(s: pd.Series) -> pd.Series:
    return s.map(latex_text, na_action="ignore")


def repair_replacement_chars(text: str, wide: dict, narrow: dict) -> str:
    """U+FFFD by what stood there elsewhere between the same two (else one) characters on each side of the given text."""
    if "\ufffd" not in text:
        return text
    out = list(text)
    for m in re.finditer("\ufffd", text):
        i = m.start()
        key = (text[max(0, i - 2) : i], text[i + 1 : i + 3])
        out[i] = wide.get(key) or narrow.get((text[i - 1 : i], text[i + 1 : i + 2])) or "\ufffd"
    return "".join(out)
