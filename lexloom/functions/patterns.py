"""Patterns, word lists and limits that results depend on, in Java's dialect without its flags."""

# Markers of regulations in Spanish.
ARTICLE = r"(?:^|\n)(?:#{1,4}[ \t]+|[-*+][ \t]+|\d+\.[ \t]+)?[ \t]{0,6}Art(?:ículo|iculo|\.)[ \t]+(\d+(?:[ \t]*[-–][ \t]*[A-Za-z]+)?)"
HEADING = (
    r"(?:^|\n)(?:#{1,4}[ \t]+)?[ \t]{0,4}(TÍTULO|CAPÍTULO|SECCIÓN|Título|Capítulo|Sección)[ \t]+"
    r"([IVXLCDM\d]+|PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO|SÉPTIMO|OCTAVO|NOVENO|DÉCIMO|ÚNICO)[ \t]*[.\-]?[ \t]*\n?([^\n]{0,300})"
)
PROVISION = r"(?:^|\n)[ \t]{0,4}(DISPOSICIÓN(?:ES)?[ \t]+(?:TRANSITORIA|GENERAL|FINAL|DEROGATORIA|REFORMATORIA|SUSTITUTIVA)S?)"
RESOLUTION = r"(?:^|\n)[ \t]{0,4}(RESUELVE|DISPONE|CERTIFICA|EXPIDE)[ \t]*:"
ANNEX = r"(?:^|\n)[ \t]{0,4}(ANEXO[ \t]+(?:[IVXLCDM]+|\d+|Único|ÚNICO))[ \t]*[.\-]?[ \t]*\n?([^\n]{0,400})"
HEADER = r"^[ \t]*(?:[.:\-–—]+[ \t]*)*([^.\n]{2,90}?)\.[ \t]*[-–—]?[ \t]*([A-ZÁÉÍÓÚÑ¿][\s\S]*)$"
BODY_OPENING = (
    r"^(esta|este|estos|estas|la|el|los|las|se|para|por|en|toda|todo|todos|todas|ser[aá]n?|es|son|cr[eé]ase|cuando|sin|a[ \t]+fin|"
    r"de[ \t]+acuerdo|de[ \t]+conformidad|proteger|garantizar)(?:[^\p{L}\p{N}_]|$)"
)
CITED_BEFORE = r"(?:^|[^\p{L}\p{N}_])(el|del|los|las|al|en|presente|mismo|citado|referido|dicho|este|esta)[ \t]*\n?\z"
CITED_AFTER = r"^[\s,.\d]*(?:n[uú]meral[\s\d,]*)?(?:de la|del)[ \t]+(constituci|ley|c[oó]digo|reglamento|norma)"
ARTIFACT_LINE = r"^\s*(?:\d{1,4}|\d{1,3}\s*/\s*\d{1,3}|[\w.+-]+@[\w.-]+\.\w+)\s*$"
DATE = r"(\d{1,2})\s+de\s+(\w+)\s+de\s+(\d{4})"
NORM_KIND = r"(LEY\s+ORGÁNICA|LEY\s+ORDINARIA|DECRETO\s+EJECUTIVO|REGLAMENTO|RESOLUCIÓN|CIRCULAR|NORMA\s+TÉCNICA)"
CITATION = r"\b[Aa]rt(?:ículo|iculo)?\s*\.?\s*(\d+[\w]*)\b"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
VARIANT_ARTICLE = r"(?:^|\n)(?:#{1,4}[ \t]+|[-*+][ \t]+|\d+\.[ \t]+)?[ \t]{0,6}Art(?:ículo|iculo|\.)[ \t]+(\d+[\w]*)[ \t]*[.\-–—]?[ \t]*([^\n]{0,250})"

# The kinds of norms of the second style of parsing, in order of rank, and Markdown headings.
VARIANT_KINDS = ["RESOLUCIÓN", "PROYECTO DE LEY", "LEY ORGÁNICA", "LEY", "NORMATIVA"]
MARKDOWN_HEADING = r"^(#{1,6})[ \t]+(.*)$"

# Levels of compliance and defaults of search, grading and chunking.
LEVELS = ["cumple", "parcial", "omision", "no_aplica"]
TOP_K, TOP_N, MIN_SCORE, OVERFETCH, MAX_TOKENS, MISSING_SCORE = 5, 3, 0.30, 5, 512, 0.5

# The second style of parsing, and the texts around the articles that an analysis reads.
VARIANT_HEADING = HEADING.replace("|ÚNICO)", "|Único|ÚNICO)")
VARIANT_RESOLUTION = r"(?:^|\n)[ \t]{0,4}(CONSIDERANDO|RESUELVE|CERTIFICA|DISPONE)[ \t]*:"
VARIANT_TITLE_END = r"Art(?:ículo|\.)[ \t]+\d.*$"
VARIANT_TITLE_WORDS = ["LEY", "RESOLUCIÓN", "RESOLUCION", "PROYECTO", "REGLAMENTO", "DECRETO"]
MONTH_DATE = r"(\d{1,2})\s+de\s+(" + "|".join(MONTHS) + r")\s+de\s+(\d{4})"
NO_TITLE, NO_SECTION = "Sin título", "(sin sección)"
CITED_TITLE, NEAR_TITLE = "COINCIDENCIAS LÉXICAS:\n", "CANDIDATOS SEMÁNTICOS VALIDADOS:\n"
NO_REFERENCES = "Sin artículos normativos relevantes identificados."
