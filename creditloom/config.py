"""Parameters and fixed values shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

# Schema and method versions written into data.
STAGING_SCHEMA = "musicbrainz-etl-staging-v1"
AGGREGATE_SCHEMA = "musicbrainz-etl-aggregate-v1"
SERVING_SCHEMA = "musicbrainz-instrument-credits-serving-v2"
METHODOLOGY_VERSION = "0.5.0"
VOCABULARY_METHODOLOGY = "artist-vocabulary-candidate-2"

# Names that occur in the data.
CONTEXT_RELATIONS = ("vocal", "vocals", "programming", "samples", "sampled")
DIRECT_SCOPES = ("recording", "track")
NATURES = ("acoustic", "electric", "electronic", "sampled", "hybrid")
# The rules a temperament may be read from.
TEMPERAMENT_RULES = ("recurring-percussion-synthesizers", "electric-plucked-strings", "recurring-sampled", "recurring-electronic", *(f"dominant-{n}" for n in NATURES))
PROJECTION_STATUSES = ("pending", "complete", "complete_empty", "failed")
FINISHED_STATUSES = ("complete", "complete_empty", "failed")
RECORDING_STATUSES = (
    "resolved",
    "unresolved_identity",
    "pending_enrichment",
    "ambiguous",
    "resolved_without_evidence",
    "transient_failure",
    "terminal_failure",
)
PERIODS = ("7day", "1month", "3month", "6month", "12month", "overall")
TRACK_VIEW = "track_palette"
VOCABULARY_VIEW = "artist_vocabulary"

# Placeholder artists that never enter a vocabulary.
PLACEHOLDER_ARTIST_MBIDS = (
    "125ec42a-7229-4250-afc5-e057484327fe",
    "f731ccc4-e22a-43af-a747-64213329e088",
    "eec63d3c-3b81-4ad4-b1e4-7c147d4d2b61",
    "c5dcb5d2-77e3-4ac8-9674-d0df027127b9",
    "89ad4ac3-39f7-470e-963a-56509c546377",
)
PLACEHOLDER_ARTIST_NAMES = (
    "[unknown]",
    "[anonymous]",
    "[no artist]",
    "[test]",
    "various artists",
)

# Retry delays in seconds, by attempt.
RETRY_DELAYS = (60, 300, 1800, 10800, 43200)


@dataclass(frozen=True)
class Policy:
    """Thresholds of the scoring rules; the defaults are the published ones."""

    min_recordings: int = 3

    track_ratio: float = 0.05
    play_ratio: float = 0.05
    track_floor: int = 5
    artist_floor: int = 2

    nature_known_ratio: float = 0.8

    discovery_tracks: int = 3
    discovery_artists: int = 2
    discovery_share: float = 0.35

    temperament_tracks: int = 3
    temperament_second_share: float = 0.10
    temperament_pair_family_share: float = 0.10
    temperament_pair_tracks: int = 3
    temperament_pair_share: float = 0.15
    temperament_plucked_share: float = 0.25
    temperament_electric_share: float = 0.25
    temperament_sampled_share: float = 0.15
    temperament_electronic_share: float = 0.25

    vocabulary_reach: float = 0.1
    vocabulary_artists: int = 3
    vocabulary_concentration: float = 0.7
    artist_weight_cap: float = 0.4
    featured_artists: int = 3

    page_size: int = 50
    max_pages: int = 4
    max_recording_targets: int = 50
    max_artist_targets: int = 200

    max_attempts: int = 5
    lease_minutes: int = 10
    defer_minutes: int = 2
    max_pending_units: int = 720
    daily_new_units: int = 360
    daily_calls: int = 1_000

    # Sizes a document and a nested list aim at. Beyond them they go on in numbered parts.
    shard_part_bytes: int = 1_048_576
    list_part_rows: int = 1_000

    @property
    def max_tracks(self) -> int:
        return self.page_size * self.max_pages


DEFAULT = Policy()
