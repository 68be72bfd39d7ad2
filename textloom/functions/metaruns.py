"""Sections, headers and authors of Markdown run files as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import judge as J
from textloom.functions import text as T

# Markers that stand alone before a paragraph.
MARKERS = ("HYPOTHESE", "BEWEISFÜHRUNG", "FAZIT", "KENNZAHLEN[- ]ÜBERRASCHUNG", "FREIER RAUM", "UNTERSUCHUNGSFRAGE", "DESTILLATION")

# Spellings of author names and the form they are counted under.
AUTHORS = {
    "Puschkin": ("Puschkin", "Pushkin", "Puškin", "PUSKIN", "Puskin", "Пушкин"), "Blok": ("Blok", "Блок"), "Brodskij": ("Brodskij", "Brodsky", "Бродский"), "Homer": ("Homer", "Homeros"),
    "Žukovskij": ("Žukovskij", "Zhukovskij", "Zhukovsky", "Žukovsky", "Жуковский"), "Veresaev": ("Veresaev", "Veresayev", "Вересаев"), "Starikovskij": ("Starikovskij", "Starikovsky", "Стариковский"),
}

# Words that look like names and are none.
NO_NAMES = tuple(
    """Die Der Das Ein Eine Keine Seine Ihre Diese Jede Alle Auch Dabei Zudem Hierbei Welche Während Weder Wenige Manche Eigene
    Quelle DESTILLATION Beweisführung Hypothese Dominante Operation Vers Satz Stil Grundoperation Kennzahl Kennzahlen Vergleich
    Kernhypothese Synthese Analyse Ergebnis Übersetzung Original Originals Text Werk
    Form Lösung Inhalt Inhalts Weg Wort Reim Rhythmus Klang Bild Kraft Stimme Flusses Fluss Grund Sinn Art Weise
    Mittel Werkzeug Zeichen Ausdruck Wirkung Natur Seele Geist Welt Raum Zeit Sprache Dichtung Poesie Lyrik Epik
    Morphologie Morphologische Lexik Syntax Enjambement TTR Satzlänge Satzlängen Komposita Kompositum Fremdwort Fremdwörter
    Hotspot Statistik Vergleichstabelle
    Verfahren Prinzip Methode Technik Strategie Haltung Position Perspektive Ansatz Modus Funktion Rolle Wert Bedeutung Effekt
    Charakter Typus Profil Muster Struktur Spannung Kontrast Differenz Beziehung Homers
    Demontage Gemeinschaftsbildung Machtdemonstration Selbstexpansion Mobilisierung Exklusion Verklärung Verdichtung Fragmentierung
    Zertrümmerung Entgrenzung Transzendierung Expansion Diskreditierung Delegitimierung Entwertung Redefinition Rekonfiguration
    Subsumption Imperativ Imperativbildung Appell Vision Visionär Prophetie Prophezeiung Polemik Polemische Polemischer
    Agency Intentional Intentionale Intentionaler Responsiv Responsive Entbündelnd Entbündelnde Entbündelnder Keim Keime Vorbereitung
    Hegemonie Hegemoniale Imperiale Imperialer Wendung Entwicklung Transformation
    Gedicht Gedichts Gedichte Stils Stile Texte Texten Werks Werke Autor Autors Autoren Dichter Dichters Lyriker Lyrikers
    Phase Phasen Periode Perioden Stadium Stadien Stufe Stufen Schritt Schritte
    Identifikation Identifizierung Klassifikation Kategorisierung Interpretation Untersuchung Vergleichs Radikalisierung Eskalation
    Konstitution Konstruktion Dekonstruktion Dispersion Genealogie Kontinuität Stabilität Instabilität Variabilität
    Validierung Falsifikation Verifikation Adjudikation Gegenposition Bestätigung""".split()
)
# The shorter list of the style laboratory.
NO_LAB_NAMES = tuple(
    """Quelle DESTILLATION Beweisführung Hypothese Dominante Operation Vers Satz Stil Grundoperation Kennzahl Vergleich Synthese
    Übersetzung Original Originals Text Werk Form Lösung Inhalt Wort Reim Rhythmus Klang Bild Kraft Stimme Grund Sinn
    Sprache Dichtung Poesie Lyrik Epik Morphologie Enjambement Komposita
    Verfahren Prinzip Methode Technik Strategie Haltung Position Modus Funktion Charakter Homers""".split()
)
NO_SURNAME_ENDINGS = ("ая", "яя", "ое", "ее", "ого", "его", "ому", "ему", "ыми", "ими")
UPPER, LOWER = "\\p{Lu}", "\\p{Ll}"


def between(text: Column, start: str, end: str) -> Column:
    """Text from below the heading ``start`` to the heading ``end`` or the text's end."""
    head = r"(?:#{1,4}[ \t]*)?\*{0,2}"
    found = F.regexp_extract(text, rf"(?is)(?:\A|\n){head}{start}\*{{0,2}}[^\n]*\n(.*?)(?=\n{head}(?:{end})\*{{0,2}}|\z)", 1)
    return F.nullif(T.strip(found), F.lit(""))


def destillation(text: Column) -> Column:
    own = between(text, "META-DESTILLATION", "META-SEZIEREN|META-BEOBACHTEN|Nachträgliche FREIE FRAGE")
    return F.coalesce(own, F.nullif(T.strip(F.regexp_extract(text, r"(?is)(?:\A|\n)(?:#{1,4}[ \t]*)?FREIE FRAGE[^\n]*\n(.*)", 1)), F.lit("")))


def last_sentence(text: Column) -> Column:
    return F.nullif(F.element_at(F.split(F.regexp_replace(destillation(text), r"([.!?])\s+", f"$1{T.CUT}"), T.CUT), -1), F.lit(""))


def beobachten(text: Column) -> Column:
    return between(text, "META-BEOBACHTEN", "META-DESTILLATION")


def free_space(text: Column) -> Column:
    found = F.regexp_extract(beobachten(text), r"(?is)(?:\A|\n)(?:#{1,4}[ \t]*)?\*{0,2}(?:4\.\s*FREIER RAUM|FREIER RAUM\s*[-—]\s*STABILIT)\*{0,2}(.*?)(?=\n(?:#{1,4}[ \t]*)?[5-8]\.\s|\z)", 1)
    return F.nullif(T.strip(found), F.lit(""))


def table_lines(text: Column) -> Column:
    """Rows of the Markdown tables in the first section."""
    return F.filter(F.split(F.coalesce(between(text, "META-SEZIEREN", "META-BEOBACHTEN"), F.lit("")), "\n"), lambda s: s.rlike(r"^\s*\|"))


def is_run_file(text: Column) -> Column:
    return text.rlike(r"(?i)(?:\A|\n)(?:#{1,4}\s*)?META-DESTILLATION") | text.rlike("(?i)# Meta-Hermeneutic Analyse") & text.rlike(r"(?i)(?:\A|\n)(?:#{1,4}\s*)?FREIE FRAGE")


def header(text: Column) -> Column:
    def get(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    version = F.coalesce(get(r"Meta-Hermeneutic Analyse\s*\((v[0-9]+(?:\.[0-9]+)*)"), F.when(F.contains(text, F.lit("Meta-Hermeneutic Analyse")), "pre-v2.4"))
    return F.struct(
        version.alias("version"), get(r"\*\*Runs?:\*\*\s*([0-9]+)").try_cast("int").alias("runs"), get(r"\*\*Dauer:\*\*\s*([0-9.]+)s").try_cast("double").alias("seconds"),
        get(r"\*\*Modell Beobachten:\*\*\s*(\S+)").alias("model_beobachten"), get(r"\*\*Modell Destillation:\*\*\s*(\S+)").alias("model_destillation"), (get(r"\*\*Etappe-1-Daten:\*\*\s*(Ja|Nein)") == "Ja").alias("has_stage1"), get(r"\*\*Stufen-Dauer:\*\*\s*([^\n]+)").alias("stages"),
    )


def variant(version: Column) -> Column:
    """A before 2.4, B before 2.7, then C."""
    parts = F.split(F.regexp_replace(version, "^v", ""), r"\.")
    major, minor = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2))
    return F.when(minor.isNull(), "A").when((major > 2) | (major == 2) & (minor >= 7), "C").when((major == 2) & (minor >= 4), "B").otherwise("A")


def core_hypothesis(text: Column) -> Column:
    """The first paragraph of the global synthesis that is no marker and no heading."""
    body = F.coalesce(F.nullif(F.regexp_extract(text, r"(?ims)^###[ \t]+GLOBALE\s+SYNTHESE[^\n]*\n(.*)", 1), F.lit("")), J.section(text, "GLOBALE SYNTHESE"))
    marker = rf"\*{{0,2}}\s*(?:{'|'.join(MARKERS)})\s*[:*]*"
    parts = F.transform(F.split(F.regexp_replace(body, rf"(?i)({marker})\n(?!\n)", "$1\n\n"), "\n\n"), T.strip_lines)
    return F.try_element_at(F.filter(parts, lambda p: (p != "") & ~p.rlike(rf"(?i)^\s*{marker}\s*$") & ~p.rlike(r"^#{1,6}\s")), F.lit(1))


def genitive_of(name: Column, words: tuple[str, ...]) -> Column:
    """Whether a name is one of the words with a genitive ending."""
    return F.endswith(name, F.lit("s")) & (F.regexp_replace(name, "s$", "").isin(*words) | (F.length(name) > 4) & F.regexp_replace(name, "es$", "").isin(*words))


def likely_author(name: Column) -> Column:
    short = F.endswith(name, F.lit("s")) & (F.length(name) <= 6) & name.rlike(f"^{UPPER}")
    compound = name.rlike("^(?:Auf|Bei|Durch|Für|Gegen|In|Mit|Nach|Über|Um|Unter|Vom|Von|Vor|Zu)[A-ZÄÖÜ][a-zäöüß]+")
    return (F.length(name) >= 4) & ~name.isin(*NO_NAMES) & ~genitive_of(name, NO_NAMES) & ~short & ~compound & ~name.rlike(f"(?:{'|'.join(NO_SURNAME_ENDINGS)})$")


def likely_lab_author(name: Column) -> Column:
    """As ``likely_author``, by the shorter list and the genitive alone."""
    return (F.length(name) >= 4) & ~name.isin(*NO_LAB_NAMES) & ~genitive_of(name, NO_LAB_NAMES)


def canonical(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for form, ways in AUTHORS.items() for way in ways for x in (way, form)))
    return F.coalesce(F.try_element_at(known, name), name)


def authors(text: Column) -> Column:
    """Sorted distinct names that a source number, or a Russian surname ending, gives away."""
    name = f"{UPPER}[{LOWER}-]+(?: {UPPER}[{LOWER}-]+)?"
    found = F.concat(
        F.regexp_extract_all(text, F.lit(rf"({name})\s*\(\s*Quelle\s*[0-9]+\s*\)"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(rf"Quelle\s*[0-9]+\s*[\[\]:]?\s*({UPPER}[{LOWER}-]+)"), F.lit(1)),
        F.regexp_extract_all(text, F.lit("([А-ЯЁ][а-яё]+(?:ский|ская|ина|ова|ева|ов|ев|ин|ий|ый|ой|ко|юк|ук|ич))(?![а-яё])"), F.lit(1)),
    )
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, likely_author), canonical)))


def source_authors(text: Column) -> Column:
    """(source, author, priority) of every place where a text says which source is whose."""
    word = f"{UPPER}[{LOWER}-]+"
    out = F.array().cast("array<struct<source:int,author:string,priority:int>>")
    for priority, (pattern, number, name) in enumerate(((rf"({word})\s*\(?\s*Quelle\s*([0-9]+)\s*\)?", 2, 1), (rf"Quelle\s*([0-9]+)\s*[\[\]:]?\s*({word})", 1, 2), (r'"QUELLE\s*([0-9]+)"\s*:\s*"([^"]+)"', 1, 2))):
        ids, names = F.regexp_extract_all(text, F.lit(pattern), F.lit(number)), F.regexp_extract_all(text, F.lit(pattern), F.lit(name))
        out = F.concat(out, F.transform(F.arrays_zip(ids.alias("n"), names.alias("a")), _tagged(priority)))
    return out


def _tagged(priority: int):
    return lambda z: F.struct(z["n"].cast("int").alias("source"), z["a"].alias("author"), F.lit(priority).alias("priority"))


def sound_sums(text: Column) -> Column:
    """(source, total) of the rows of the sound table, within 2 000 characters of its start."""
    at = F.coalesce(F.nullif(F.instr(text, "Klang-Vergleichstabelle"), F.lit(0)), F.nullif(F.instr(text, "Alliterationen"), F.lit(0)))
    part = F.substring(text, at, F.lit(2000))
    row = r"\|\s*QUELLE\s*([0-9]+)\s*\|\s*([0-9]+)\s*\|\s*([0-9]+)\s*\|\s*([0-9]+)\s*\|\s*([0-9]+)\s*\|"
    cols = [F.transform(F.regexp_extract_all(part, F.lit(row), F.lit(i)), lambda x: x.cast("int")) for i in range(1, 6)]
    zipped = F.arrays_zip(*(c.alias(n) for c, n in zip(cols, "nabcd", strict=True)))
    return F.transform(zipped, lambda z: F.struct(z["n"].alias("source"), (z["a"] + z["b"] + z["c"] + z["d"]).alias("total")))


def json_map(text: Column, allowed: tuple[str, ...] | None = None) -> Column:
    """A JSON object of strings; nulls go, and words outside of a vocabulary become null."""
    body = F.concat(F.regexp_extract(text, r"(?s)(\{.*?)\s*\}?\s*\z", 1), F.lit("}"))
    found = F.map_filter(F.from_json(body, "map<string,string>"), lambda _, v: v.isNotNull())
    return F.transform_values(found, lambda _, v: F.when(v.isin(*allowed), v)) if allowed else found


def stability(share: Column) -> Column:
    return F.when(share >= 0.88, "stabil").when(share >= 0.59, "häufig").otherwise("variabel")
