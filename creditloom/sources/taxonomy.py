"""The controlled taxonomy: families, instruments, and the names that map to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Slug, name, nature.
FAMILIES = [
    ("plucked-strings", "Cordas dedilhadas", "acoustic"),
    ("percussion", "Percussão", "acoustic"),
    ("synthesizers", "Sintetizadores", "electronic"),
    ("acoustic-keys", "Teclas acústicas", "acoustic"),
    ("bowed-strings", "Cordas friccionadas", "acoustic"),
    ("sampled-sounds", "Sons sampleados", "sampled"),
    ("woodwinds", "Madeiras", "acoustic"),
    ("brass", "Metais", "acoustic"),
    ("voice", "Voz", "acoustic"),
    ("electric-keys", "Teclas elétricas e eletrônicas", "hybrid"),
]

# Slug, name, family, nature.
INSTRUMENTS = [
    ("electric-guitar", "Guitarra elétrica", "plucked-strings", "electric"),
    ("electric-bass", "Baixo elétrico", "plucked-strings", "electric"),
    ("drums", "Bateria", "percussion", "acoustic"),
    ("synthesizer", "Sintetizador", "synthesizers", "electronic"),
    ("piano", "Piano", "acoustic-keys", "acoustic"),
    ("cello", "Violoncelo", "bowed-strings", "acoustic"),
    ("acoustic-guitar", "Violão", "plucked-strings", "acoustic"),
    ("cavaquinho", "Cavaquinho", "plucked-strings", "acoustic"),
    ("pandeiro", "Pandeiro", "percussion", "acoustic"),
    ("surdo", "Surdo", "percussion", "acoustic"),
    ("tamborim", "Tamborim", "percussion", "acoustic"),
    ("cuica", "Cuíca", "percussion", "acoustic"),
    ("sampler", "Sampler", "sampled-sounds", "sampled"),
]

# Accepted credit names (alias form) of each instrument.
INSTRUMENT_ALIASES = {
    "electric-guitar": ["electric guitar", "guitar electric"],
    "electric-bass": ["electric bass", "bass guitar", "electric bass guitar"],
    "drums": ["drum kit", "drums drum set"],
    "synthesizer": ["synthesizer", "synth"],
    "piano": ["piano"],
    "cello": ["cello"],
    "sampler": ["sampler"],
    "acoustic-guitar": ["acoustic guitar", "classical guitar", "nylon string guitar"],
    "cavaquinho": ["cavaquinho"],
    "pandeiro": ["pandeiro"],
    "surdo": ["surdo"],
    "tamborim": ["tamborim"],
    "cuica": ["cuica"],
}

# Names that name a family only.
FAMILY_ALIASES = {
    "plucked-strings": [
        "guitar", "12 string guitar", "banjo", "baritone guitar", "electric sitar", "mandocello",
        "mandolin", "pedal steel guitar", "tenor guitar",
    ],
    "percussion": ["drum", "drums", "membranophone", "percussion", "vibraphone"],
    "bowed-strings": ["double bass", "sarangi", "viola", "violin"],
    "acoustic-keys": ["reed organ"],
    "woodwinds": [
        "flute", "bass clarinet", "bassoon", "alto saxophone", "baritone saxophone", "clarinet",
        "contrabassoon", "english horn", "oboe", "piccolo", "recorder", "saxophone",
        "soprano saxophone", "tenor saxophone",
    ],
    "brass": [
        "brass", "cornet", "euphonium", "flugelhorn", "french horn", "horn", "trombone", "trumpet", "tuba",
    ],
    "voice": [
        "voice", "vocal", "vocals", "lead vocals", "backing vocals", "background vocals", "choir",
        "chorus", "singer",
    ],
    "electric-keys": [
        "electric piano", "digital piano", "electric organ", "electronic piano", "piano electric", "keyboard",
    ],
}

# Older public slugs.
INSTRUMENT_SLUG_ALIASES = [
    ("guitarra-eletrica", "electric-guitar"),
    ("baixo-eletrico", "electric-bass"),
    ("bateria", "drums"),
    ("sintetizador", "synthesizer"),
    ("violoncelo", "cello"),
]
FAMILY_SLUG_ALIASES = [
    ("cordas-dedilhadas", "plucked-strings"),
    ("percussao", "percussion"),
    ("sintetizadores", "synthesizers"),
    ("teclas-acusticas", "acoustic-keys"),
    ("cordas-friccionadas", "bowed-strings"),
    ("sons-sampleados", "sampled-sounds"),
]


@dataclass(frozen=True)
class Taxonomy:
    families: DataFrame
    instruments: DataFrame
    instrument_aliases: DataFrame
    family_aliases: DataFrame
    external_ids: DataFrame
    slug_aliases: DataFrame


def load_taxonomy(spark: SparkSession, external_ids: list[tuple[str, str]] | None = None) -> Taxonomy:
    """The taxonomy as small frames of known size; Catalyst broadcasts them by that size."""
    frame = spark.createDataFrame
    alias = "normalized_alias string, {} string"
    return Taxonomy(
        families=frame(FAMILIES, "family_slug string, family_name string, family_nature string"),
        instruments=frame(
            INSTRUMENTS,
            "instrument_slug string, instrument_name string, family_slug string, instrument_nature string",
        ),
        instrument_aliases=frame(
            [(name, slug) for slug, names in INSTRUMENT_ALIASES.items() for name in names],
            alias.format("instrument_slug"),
        ),
        family_aliases=frame(
            [(name, slug) for slug, names in FAMILY_ALIASES.items() for name in names],
            alias.format("family_slug"),
        ),
        external_ids=frame(external_ids or [], "external_id string, instrument_slug string"),
        slug_aliases=frame(
            [(a, s, "instrument") for a, s in INSTRUMENT_SLUG_ALIASES]
            + [(a, s, "family") for a, s in FAMILY_SLUG_ALIASES],
            "alias_slug string, canonical_slug string, kind string",
        ),
    )
