"""Registry of all queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.operators import catalogue, checks, corroboration, credits, dated, evidence, filters, integrity, matching, named, normalise, places, ranking, reading, recordings, resolution, resolve, rights, scoring, search, text, upkeep, webpages
from cadenza.plans.oracles import ORACLES as _ORACLES
from cadenza.plans.oracles_checks import ORACLES as _CHECKS
from cadenza.plans.oracles_matching import ORACLES as _MORE
from cadenza.plans.oracles_reader import ORACLES as _READER
from cadenza.plans.oracles_resolve import ORACLES as _RESOLVE
from cadenza.plans.oracles_rules import ORACLES as _RULES
from cadenza.plans.oracles_quality import ORACLES as _QUALITY
from cadenza.plans.oracles_search import ORACLES as _SEARCH
from cadenza.sources.catalogue import Catalogue
from cadenza.streaming.play_log import windowed_plays

FLAGSHIP = "artist_counts"


def _query(f: Callable[..., DataFrame], *args, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Catalogue(spark, sf_dir), *args, **options)


_MODULES = {
    catalogue: "artist_counts kind_counts recent_recordings favourites on_this_day venue_counts genre_counts musician_counts role_counts top_acts_of_venue instruments show_places track_places first_images image_chain personnel",
    integrity: "visible_recordings visible_counts orphan_acts owed_recordings wiped_personnel replaced_slice upserted",
    scoring: "quality_composite non_music completeness fit_statistics confusion smoothed_bins isotonic_bins latency_quantiles waveform evidence confidence confidence_gates scored_recordings",
    resolution: "tiered_lookup gram_frequency fuzzy_candidates similar_names content_duplicates sole_owner stable_sample dominant_place capped_aliases popularity area_chain",
    ranking: "round_robin lead_first queue_order collision_names natural_keys release_choice date_spans status_buckets grid_search next_places",
    matching: "equal_sets dated_names shows_covering unique_date_matches tiered_match title_overlap engineer_roles only_users run_changes field_report verdict_reasons shelf_pool",
    filters: "name_contains begins_in listed_statuses bounded_arguments whole_word archive_lookup paged_recordings skipped_last quality_sorted errors_last article_sorted top_candidates run_rollup waiting_paths first_run window_features weighted_means balanced_folds cooled_down resumable_work access_recency run_duplicates allowed_attempts",
    normalise: "normal_names act_cores event_keys path_keys track_flags retired_flags canonical_places sort_names lucene_queries archive_items",
    resolve: "resolved_dates resolved_places show_kinds aligned_tracks disc_shortfall incomplete_releases duplicate_shows owned_wholly checksum_matches performance_members judgements cross_validated learned_aliases technical_gates rescored",
    upkeep: "owed_work orphans orphan_places dangling_memberships stale_staging placeholder_venues filled_roles outdated_analyses tag_inventory group_spread roster_stints migrated_counts derived_sets demotable",
    rights: "rights_rules",
    reading: "feature_counts decoded_roles",
    places: "peeled_places",
    webpages: "catalogue_shows linked_text",
    corroboration: "corroboration track_corroboration misspelt_names",
    recordings: "folder_names vector_signals play_sessions returned_offers",
    checks: "named_acts checksum_files",
    named: "credited_titles folder_marks safe_names whole_years graded_events",
    evidence: "weighed_candidates shareable_recordings",
    credits: "engineer_credits",
    dated: "mentioned_dates event_dates",
    text: "parsed_dates source_hints links excerpts turn_statistics json_counts infix recently_played",
}
QUERIES = {name: _query(getattr(module, name)) for module, names in _MODULES.items() for name in names.split()}
QUERIES |= {
    "search_one_term": _query(search.search, ("widget",)),
    "search_two_terms": _query(search.search, ("red", "widget")),
    "search_groups": _query(search.search_all, "Customer nation"),
    "search_mixed": _query(search.search_all, "customer 1997-05"),
    "search_date_only": _query(search.search_all, "3/9/96"),
    "search_albums": _query(search.search_all, "red widget"),
    "search_people": _query(search.search_people, "play c"),
    "search_members": _query(search.search_people, "player 1997-05"),
    "hourly_plays": lambda spark, sf_dir: windowed_plays(Catalogue(spark, sf_dir).table("events")),
    "search_month": _query(search.search_dated, 1997, 5),
}
ORACLES = {k: v for k, v in (_ORACLES | _MORE | _RULES | _RESOLVE | _READER | _CHECKS | _SEARCH | _QUALITY).items() if k in QUERIES}
