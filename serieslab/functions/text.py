"""Text normalisation, names, paths and identifiers."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folded() -> tuple[str, str]:
    """Letters and digits beyond ASCII whose compatibility decomposition holds one ASCII letter or digit."""
    source, target = [], []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0), *range(0xFF10, 0xFF5B)]:
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1 and plain.isalnum():
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _folded()


def fold_accents(c: Column) -> Column:
    """ASCII form of letters and digits with accents; what has none is dropped."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def norm_text(c: Column) -> Column:
    """Search key: accents folded, lower case, runs of other characters as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", " "))


def clean_text(c: Column, corrected: bool = False) -> Column:
    """Replacement characters and NULs dropped, runs of blanks and tabs as one blank.

    The text's UTF-8 bytes read as Latin-1 take its place if that shows fewer broken letters, or as many
    and more Spanish ones; ``corrected`` leaves this out.
    """
    again = F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    count = lambda t, pattern: F.regexp_count(t, F.lit(pattern))
    bad = lambda t: count(t, "\ufffd") + count(t, "[\u00c0-\u00df][\u0080-\u00ff]") + count(t, "\u00c3[\u0080-\u00ff]")
    good = lambda t: count(t, "[áéíóúñüÁÉÍÓÚÑ]")
    better = (bad(again) < bad(c)) | ((bad(again) == bad(c)) & (good(again) > good(c)))
    chosen = c if corrected else F.when(better, again).otherwise(c)
    return F.regexp_replace(F.translate(chosen, "\x00\ufffd", ""), r"[ \t]+", " ")


def capped(c: Column, most: int = 24_000) -> Column:
    """Trimmed text of at most ``most`` characters."""
    return F.substring(F.trim(c), 1, most)


def norm_qualifier(c: Column) -> Column:
    """Qualitative result: lower case, letters of Spanish only."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-záéíóúñ]+", " "))


def fallback_key(c: Column) -> Column:
    """Key of an analyte that no synonym knows: ``otro:`` and its normalised name in snake case."""
    return F.concat(F.lit("otro:"), F.translate(norm_text(c), " ", "_"))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


# Words and suffixes that mark an institution, laboratories known by name, particles of surnames.
INSTITUTION = r"(?U)(?i)\b(LABORATORIOS?|LAB|CL[IÍ]NICA|SANATORIO|HOSPITAL|INSTITUTO|CENTRO\s+M[EÉ]DICO|CENTRO\s+DE|SERVI[CG]IO\s+DE|ESTUDIO\s+|MEDICAL\s+CENTER|FUNDACI[OÓ]N)\b"
COMPANY = r"(?i)(^|\s)(S\.?R\.?L\.?|LTDA\.?|EIRL|S\.?A\.?C\.?I\.?|S\.?A\.?S|C\.?I\.?F\.?A\.?)\s*$"
KNOWN_LABS = ("CURIE", "MEDVITAL", "SANACOOP", "SANISIDRO", "YPACARAI", "BRUNELLI")
PARTICLES = ("DE", "DEL", "LA", "LAS", "LOS", "DA", "DO", "DI", "VON", "VAN")


def is_institution(name: Column) -> Column:
    """Whether a supposed person's name is that of a laboratory or company."""
    return name.rlike(INSTITUTION) | (name.rlike(COMPANY) & ~name.contains(",")) | F.upper(name).isin(*KNOWN_LABS)


def person_name(raw: Column) -> Column:
    """``SURNAMES, GIVEN`` as ``GIVEN SURNAMES`` in capitals without particles; empty for institutions."""
    name = F.upper(F.btrim(F.regexp_replace(clean_text(raw), r"\s+", " "), F.lit(" :,;.")))
    parts = F.transform(F.split(name, ","), lambda p: F.trim(p))
    turned = F.when((F.size(parts) == 2) & (parts[0] != "") & (parts[1] != ""), F.concat_ws(" ", parts[1], parts[0])).otherwise(name)
    bare = F.regexp_replace(turned, rf"(?U)\b({'|'.join(PARTICLES)})\b", " ")
    return F.when(is_institution(name), F.lit("")).otherwise(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def name_tokens(name: Column) -> Column:
    """Distinct tokens that identify a person: over one character and no particle."""
    particles = F.array(*(F.lit(p.lower()) for p in PARTICLES[:8]))
    return F.array_distinct(F.filter(F.split(norm_text(name), " "), lambda t: (F.length(t) > 1) & ~F.array_contains(particles, t)))


def given_name(name: Column) -> Column:
    """First word, lower case; all but a-z and digits part words (accents are not folded here)."""
    return F.split_part(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), F.lit(" "), F.lit(1))


def extension(name: Column) -> Column:
    """Extension with its dot, lower case; empty without a dot."""
    return F.regexp_extract(F.lower(name), r"(\.[^.]*)$", 1)


# Extensions of images, of other accepted files, and of programs that are refused.
IMAGE_EXT = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tif", ".tiff")
OTHER_EXT = (".pdf", ".dcm", ".dicom", ".zip", ".doc", ".docx", ".xls", ".xlsx", ".txt", ".csv", ".nii", ".nii.gz", ".mhd", ".raw")
UNSAFE_EXT = (".exe", ".dll", ".sys", ".so", ".dylib", ".bin", ".dat", ".bat", ".cmd", ".com", ".scr", ".msi", ".ocx", ".vbs", ".js", ".jar", ".class", ".ps1", ".sh", ".py", ".ini", ".cfg", ".conf", ".sys32", ".manifest", ".pdb")


def file_kind(name: Column) -> Column:
    ext = extension(name)
    return F.when(ext.isin(*IMAGE_EXT), "image").when(ext == ".pdf", "pdf").when(ext.isin(".dcm", ".dicom"), "dicom").otherwise("other")


def is_unsafe(name: Column) -> Column:
    return extension(name).isin(*UNSAFE_EXT)


def library_name(sha1: Column, name: Column) -> Column:
    """Name of a content-addressed copy."""
    return F.concat(F.substring(sha1, 1, 12), F.lit("_"), name)


def relative_path(path: Column, marker: str = "/data/") -> Column:
    """The part of an absolute path after ``marker``; other paths stay."""
    at = F.locate(marker, path)
    return F.when(at > 0, F.substr(path, at + len(marker))).otherwise(path)


def study_uid(url: Column) -> Column:
    """Identifier of a study in a viewer's address: ``study=``, else ``manage=``, else a path segment."""
    tries = (r"[?&]study=([0-9.]+)", r"[?&]manage=([0-9a-f]+)", r"/study/([0-9.]+)")
    return F.coalesce(*(F.nullif(F.regexp_extract(url, t, 1), F.lit("")) for t in tries))


def report_key(sha1: Column, lab: Column, date: Column) -> Column:
    """Key of a report; a missing date is spelt out, so that all three parts always stand."""
    return F.concat_ws("|", sha1, F.coalesce(lab, F.lit("")), F.coalesce(date, F.lit("None")))


def title_case(c: Column) -> Column:
    """Capitals at word starts, but only for texts that are all upper or all lower case."""
    return F.when((c == F.upper(c)) | (c == F.lower(c)), F.initcap(c)).otherwise(c)


def with_accent_classes(pattern: str) -> str:
    """A pattern of a-z words that also matches their accented vowels."""
    classes = {"a": "[aáã]", "e": "[eé]", "i": "[ií]", "o": "[oó]", "u": "[uúü]", "c": "[cç]"}
    return re.sub("[aeiouc]", lambda m: classes[m[0]], pattern)


# Layouts in the order in which they are tried, each with alternatives of words that all occur.
LAYOUTS = (
    ("medvital", (("angiotomografia",), ("angiotac", "medi"))),
    ("brunelli", (("brunelli",),)),
    ("curie", (("laboratoriocurie",), ("sanatorio italiano",))),
    ("ypacarai", (("ypacarai", "valores obtenidos"),)),
    ("sanisidro", (("labsanisidro",),)),
    ("verdejo", (("impedancia",), ("glucosa oxidasa",), ("itagua paraguay",), ("verdejo",))),
    ("neo", (("fecha y hora de firma", "material remitido"),)),
    ("sanacoop", (("neodiagnosticos",), ("sanacoop",), ("hemoglobina glicada",))),
)


def detect_layout(norm: Column, layouts: tuple = LAYOUTS, default: str = "verdejo") -> Column:
    """The first layout of which an alternative's words all occur in a normalised text."""
    out = F.lit(default)
    for name, alternatives in reversed(layouts):
        found = F.lit(False)
        for words in alternatives:
            every = F.lit(True)
            for w in words:
                every = every & norm.contains(w)
            found = found | every
        out = F.when(found, F.lit(name)).otherwise(out)
    return out
