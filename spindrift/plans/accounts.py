"""What the application remembers between runs: owners, accounts, playlist targets, artist
mappings, mapping reviews and follows.

Each write is a set of rows keyed by its natural key, so that repeating it changes nothing.
Incoming rows carry `ordinal`; of several rows of one key the last one's values stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import first_by, upsert

# What an approved import and a sure match say of themselves.
IMPORT_SOURCE, IMPORT_REASON = "spotify_follow_import", "User approved followed-artist import"
MATCH_SOURCE = "musicbrainz_conservative_auto_match"
OWNER_EMAIL_KEY = ["email"]


def _over(df: DataFrame, **values: Column | str | bool | None) -> DataFrame:
    return df.withColumns({n: v if isinstance(v, Column) else F.lit(v) for n, v in values.items()})


def upsert_owners(owners: DataFrame, rows: DataFrame) -> DataFrame:
    """Owners (user_id, email, display_name) by e-mail; the name is written over."""
    return upsert(owners, rows, OWNER_EMAIL_KEY, "ordinal", ["display_name"])


def upsert_accounts(accounts: DataFrame, rows: DataFrame) -> DataFrame:
    """Accounts by (provider, provider_account_id).

    A new sign-in writes the tokens' columns, clears the marks of a disconnected account and
    keeps a name or user id that it does not bring.
    """
    columns = [c for c in accounts.columns if c not in ("account_id", "user_id", "provider", "provider_account_id", "display_name", "provider_user_id")]
    fresh = _over(rows, disconnected_at=F.lit(None).cast("timestamp"), reconnect_required=False)
    # A missing name does not write: the last one that is there is found by itself.
    keys = ["provider", "provider_account_id"]
    named = {c: F.max(F.when(F.col(c).isNotNull(), F.struct("_side", "ordinal", c)))[c].alias(f"_{c}") for c in ("display_name", "provider_user_id")}
    both = accounts.select(*keys, "display_name", "provider_user_id", F.lit(0).alias("_side"), F.lit(-1).cast("long").alias("ordinal")).unionByName(rows.select(*keys, "display_name", "provider_user_id", F.lit(1).alias("_side"), F.col("ordinal").cast("long").alias("ordinal")))
    kept = both.groupBy(*keys).agg(*named.values())
    out = upsert(accounts, fresh.select(*accounts.columns, "ordinal"), keys, "ordinal", columns).join(kept, keys)
    return out.select(*(F.col(f"_{c}").alias(c) if c in named else F.col(c) for c in accounts.columns))


def upsert_targets(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """Playlist targets (user_id, provider, playlist_id, name, snapshot_id, enabled) by user
    and provider: another playlist takes the place of the one before and is enabled."""
    return upsert(targets, _over(rows, enabled=True).select(*targets.columns, "ordinal"), ["user_id", "provider"], "ordinal", ["playlist_id", "name", "snapshot_id", "enabled"])


def import_rows(preview: DataFrame, run_id: Column | str) -> DataFrame:
    """Previews of an import run as rows to append; an empty preview appends none."""
    return preview.select((run_id if isinstance(run_id, Column) else F.lit(run_id)).alias("run_id"), "provider_artist_id", F.col("name").alias("provider_name"), "existing_artist_id", "proposed_action", "selected")


def import_mappings(mappings: DataFrame, confirmed: DataFrame, provider: str = "spotify") -> DataFrame:
    """Artist mappings after an import was confirmed, by (provider, external_id).

    `confirmed` is what `import_confirm` gives; rows that were merged or created map their
    artist, and only the artist, the confirmation and the source of a known mapping change.
    """
    done = confirmed.filter(F.col("outcome").isin("merged", "created") & F.col("artist_id").isNotNull())
    rows = done.select("artist_id", F.lit(provider).alias("provider"), F.col("provider_artist_id").alias("external_id"), F.lit(None).cast("string").alias("provider_url") if "provider_url" not in confirmed.columns else F.col("provider_url"), F.lit(True).alias("confirmed"), F.lit(1).cast("decimal(4,3)").alias("match_score"), F.lit(IMPORT_SOURCE).alias("mapping_source"), "ordinal")
    return upsert(mappings, rows, ["provider", "external_id"], "ordinal", ["artist_id", "confirmed", "mapping_source"])


def import_follows(follows: DataFrame, confirmed: DataFrame, now: Column, user: Column | str | None = None) -> DataFrame:
    """Follows after an import was confirmed; one that was given up is active again.

    With a `user`, a name or a column of `confirmed`, follows have a user_id and a source and
    are keyed by user and artist, so those of two users stay apart; the import is the source.
    """
    done = confirmed.filter(F.col("outcome").isin("merged", "created") & F.col("artist_id").isNotNull())
    rows = done.select("artist_id", now.alias("followed_at"), F.lit(True).alias("active"), "ordinal", *([] if user is None else [(user if isinstance(user, Column) else F.lit(user)).alias("user_id"), F.lit(IMPORT_SOURCE).alias("source")]))
    return upsert(follows, rows, ["artist_id"] if user is None else ["user_id", "artist_id"], "ordinal", ["active"] if user is None else ["active", "source"])


def import_confirmed(tables: dict[str, DataFrame], confirmed: DataFrame, now: Column) -> dict[str, DataFrame]:
    """What a confirmed import changes in the store: its mappings and its follows, to be
    committed together (`store.transact(lambda tables: import_confirmed(tables, ...))`)."""
    return {
        "artist_external_ids": import_mappings(tables["artist_external_ids"], confirmed),
        "artist_follows": import_follows(tables["artist_follows"], confirmed, now),
    }


def sure_mappings(mappings: DataFrame, mapped: DataFrame, provider: str = "musicbrainz") -> DataFrame:
    """Mappings after sure matches (artist_id, external_id, millis, ordinal), by artist and
    provider: another id takes the place of the one before.

    An id that another artist holds stays with that artist: the table has one artist an id.
    """
    url = F.concat(F.lit("https://musicbrainz.org/artist/"), F.col("external_id"))
    rows = mapped.select("artist_id", F.lit(provider).alias("provider"), "external_id", url.alias("provider_url"), F.lit(True).alias("confirmed"), (F.col("millis") / 1000).cast("decimal(4,3)").alias("match_score"), F.lit(MATCH_SOURCE).alias("mapping_source"), "ordinal")
    rows = first_by(rows, ["provider", "external_id"], "ordinal")
    held = mappings.select("provider", "external_id", F.col("artist_id").alias("_holder"))
    rows = rows.join(held, ["provider", "external_id"], "left").filter(F.col("_holder").isNull() | (F.col("_holder") == F.col("artist_id"))).drop("_holder")
    # Only the provider's mappings have one row an artist; the others stay as they are.
    own, others = mappings.filter(F.col("provider") == provider), mappings.filter(F.col("provider") != provider)
    return others.unionByName(upsert(own, rows.select(*mappings.columns, "ordinal"), ["artist_id", "provider"], "ordinal", ["external_id", "confirmed", "match_score"]))


def proposed_reviews(reviews: DataFrame, proposed: DataFrame, provider: str = "musicbrainz") -> DataFrame:
    """Mapping reviews (artist_id, provider, proposed_external_id, provider_name, match_score,
    status) after proposals: a proposal that is made again is pending again."""
    rows = proposed.select("artist_id", F.lit(provider).alias("provider"), F.col("external_id").alias("proposed_external_id"), F.col("name").alias("provider_name"), (F.col("millis") / 1000).cast("decimal(4,3)").alias("match_score"), F.lit("pending").alias("status"), "ordinal")
    return upsert(reviews, rows, ["artist_id", "provider", "proposed_external_id"], "ordinal", ["provider_name", "match_score", "status"])
