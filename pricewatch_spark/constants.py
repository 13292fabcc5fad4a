"""Enum sets, word lists and patterns that results depend on."""

from __future__ import annotations

# --- fixed values: enumerations ---
AVAILABILITY = ("AVAILABLE_IN_STOCK", "OUT_OF_STOCK", "UNKNOWN", "DELISTED")
FRAGRANCE_TYPES = ("EDP", "EDT", "PARFUM", "COLOGNE", "BODY_MIST")
GENDERS = ("M", "F", "UNISEX")
METHODS = ("REGEX", "LLM", "HYBRID")
STOCK_CONFIDENCE = ("HIGH", "MEDIUM", "LOW", "UNKNOWN")
STATUSES = ("PENDING", "RUNNING", "SUCCESS", "PARTIAL", "FAILED", "EMPTY")

# --- fixed values: allowed moves between availability states; DELISTED is terminal ---
MOVES = {
    "AVAILABLE_IN_STOCK": ("OUT_OF_STOCK", "UNKNOWN", "DELISTED"),
    "OUT_OF_STOCK": ("AVAILABLE_IN_STOCK", "UNKNOWN", "DELISTED"),
    "UNKNOWN": ("AVAILABLE_IN_STOCK", "OUT_OF_STOCK", "DELISTED"),
    "DELISTED": (),
}

# --- fixed values: brands, as listed ---
BRANDS = (
    "Jean Paul Gaultier", "Yves Saint Laurent", "Carolina Herrera", "Dolce & Gabbana", "Dolce and Gabbana", "Dolce Gabbana",
    "Van Cleef & Arpels", "Van Cleef Arpels", "Narciso Rodriguez", "Issey Miyake", "Viktor & Rolf", "Viktor Rolf",
    "Abercrombie & Fitch", "Abercrombie Fitch", "Oscar De La Renta", "Elizabeth Arden", "Hugo Boss", "Calvin Klein", "Tom Ford",
    "Ralph Lauren", "Marc Jacobs", "Paco Rabanne", "Giorgio Armani", "Ermenegildo Zegna", "Salvatore Ferragamo", "Roberto Cavalli",
    "Bvlgari Bulgari", "Antonio Banderas", "Huda Beauty", "Jo Malone", "Maison Margiela", "Agent Provocateur", "Juliette Has A Gun",
    "Dior", "Chanel", "Armani", "Versace", "Gucci", "Prada", "Burberry", "Givenchy", "Hermès", "Hermes", "Cartier", "Bvlgari",
    "Bulgari", "Lancome", "Lancôme", "Lacoste", "Davidoff", "Montblanc", "Mont Blanc", "Kenzo", "Azzaro", "Ferragamo", "Loewe",
    "Coach", "Valentino", "Moschino", "Miu Miu", "Chloe", "Chloé", "Thierry Mugler", "Mugler", "Balenciaga", "Diesel", "Guess",
    "Benetton", "Nautica", "Clinique", "Estée Lauder", "Estee Lauder", "Michael Kors", "Vera Wang", "Tommy Hilfiger", "Jaguar",
    "Ferrari", "Bentley", "Dunhill", "Mancera", "Lattafa", "Rasasi", "Ajmal", "Afnan", "Nishane", "Xerjoff", "Byredo", "Creed",
    "Amouage", "Penhaligon", "Acqua di Parma", "Maison Francis Kurkdjian", "Tiffany", "Jimmy Choo", "Elie Saab", "Nina Ricci",
    "Rochas", "Lolita Lempicka", "Shakira", "Benetton", "Replay", "Police", "Hollister", "Banana Republic",
)

# --- fixed values: brand groups of the category rule, as listed ---
NICHE = (
    "creed", "tom ford", "byredo", "le labo", "diptyque", " Frederic Malle", "amouage", "mancera", "montale", "parfums de marly",
    "nishane", "xerjoff", "roja", "arcana", "nasomatto", "orto parisii", "bruno acampora", "profumum roma", "tauer", "serge lutens",
    "l'artisan parfumeur", "penhaligon's", "bdk parfums", "initio",
)
DESIGNER = (
    "dior", "chanel", "gucci", "versace", "armani", "ysl", "saint laurent", "hermes", "bvlgari", "prada", "valentino", "burberry",
    "dolce & gabbana", "calvin klein", "ralph lauren", "hugo boss", "lacoste", "montblanc", "givenchy", "kenzo", "lanvin",
    "paco rabanne", "jean paul gaultier",
)
ARABIC = ("armaf", "rasasi", "al haramain", "lattafa", "swiss arabian", "ajmal", "maison alhambra", "ester bracket", "adir")
NICHE_TAGS = ("niche", "exclusive", "prestige")
ARABIC_TAGS = ("arabic", "middle eastern", "oriental")
CELEBRITY_TAGS = ("celebrity",)

# --- fixed values: patterns, in the order in which they are tried ---
VOLUME = r"\b(\d{1,5})\s*ml\b"
TYPE_PATTERNS = (
    ("PARFUM", r"\b(?:extrait\s+de\s+parfum|pure\s+parfum|parfum\s+extrait)\b"),
    ("EDP", r"\b(?:edp|eau\s+de\s+parfum)\b"),
    ("EDT", r"\b(?:edt|eau\s+de\s+toilette)\b"),
    ("COLOGNE", r"\b(?:edc|eau\s+de\s+cologne|cologne)\b"),
    ("BODY_MIST", r"\b(?:body\s+mist|body\s+splash|splash|mist)\b"),
)
GENDER_PATTERNS = (
    ("M", r"\b(?:hombre|men|man|masculino|masculine|him|pour\s+homme)\b"),
    ("F", r"\b(?:mujer|women|woman|femenino|feminine|her|pour\s+femme|dama)\b"),
    ("UNISEX", r"\b(?:unisex|unisexo)\b"),
)
VARIANT_PATTERNS = (
    r"\b(Intense|Intenso|Intensément)\b", r"\b(Sport|Sporting)\b", r"\b(Night|Nuit)\b", r"\b(Absolu|Absolute)\b",
    r"\b(Extreme|Extrême)\b", r"\b(Légère|Legere|Light)\b", r"\b(Fresh|Fraîche)\b", r"\b(Limited Edition)\b", r"\b(Collector)\b",
    r"\b(Privé|Prive)\b", r"\b(Noir)\b", r"\b(Blanc|Blanche)\b", r"\b(Red|Blue|Black|White|Gold|Silver|Rose|Pink)\b", r"\b(Flame|Fire)\b",
)
SOLD_OUT = ("agotado", "sin stock", "out of stock", "no disponible", "sold out", "unavailable", "no stock", "stock: 0")
EXPORT_COLUMNS = ("raw_title", "vendor", "price", "sku", "barcode", "url", "image_url", "tags", "stock", "available", "description")
