"""JSON records: canonical form, signatures, encryption, tolerant reading and strict checks."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .decisions import compared_versions

#: The last day that a snooze may name. Fixed value.
LAST_SNOOZE = "9998-12-31"
_BLOCK = 64


def canonical_json(text: Column) -> Column:
    """The JSON text with the keys of all objects sorted and nothing between; null for what isn't JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return F.pandas_udf(lambda s: s.map(one), "string")(text)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC of a binary or text in hex, by the digests that Spark has."""
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def signed(name: Column, payload: Column, key: bytes) -> Column:
    """The signature of a named JSON payload, whatever the order of its keys."""
    whole = F.concat(F.lit('{"name":'), F.to_json(F.array(name)).substr(F.lit(2), F.length(F.to_json(F.array(name))) - 2), F.lit(',"payload":'), canonical_json(payload), F.lit("}"))
    return hmac_sha256(whole, key)


def encrypted(plain: Column, key: bytes, iv: Column, bound: Column) -> Column:
    """AES-GCM of a binary: initial vector (12 bytes), ciphertext and tag; ``bound`` (text) must be the same to decrypt."""
    return F.aes_encrypt(plain.cast("binary"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), iv, bound.cast("binary"))


def decrypted(blob: Column, key: bytes, bound: Column) -> Column:
    """What ``encrypted`` hid; null if the blob, the key or what it is bound to has changed."""
    return F.try_aes_decrypt(blob, F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), bound.cast("binary"))


def bound_to(store: Column, record: Column, generation: Column, schema: Column) -> Column:
    """What a record's encryption is bound to: parts with their lengths, so that no two differ only in where they are cut."""
    parts = [c.cast("string") for c in (store, record, generation, schema)]
    return F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in parts])


def known_list(values: Column, known: list[str]) -> Column:
    """An array of different known values; null for any other."""
    fine = F.forall(values, lambda x: F.coalesce(x.isin(*known), F.lit(False))) & (F.size(F.array_distinct(values)) == F.size(values))
    return F.when(fine, values)


def stored_tasks(text: Column, version: int = 1) -> Column:
    """A map of task to (status, notes, until) of a stored state; null unless it is JSON of this version with tasks. What can't be read
    of a task is left out: a snooze without a day that can be goes with its status; a task of which nothing is left goes."""
    v = F.try_parse_json(text)
    kind = lambda x, path: F.schema_of_variant(F.try_variant_get(x, path, "variant"))
    raw = F.try_variant_get(v, "$.tasks", "map<string,variant>")

    def task(x: Column) -> Column:
        part = lambda k: F.when(kind(x, f"$.{k}") == "STRING", F.try_variant_get(x, f"$.{k}", "string"))
        day, named = part("snoozeUntil"), F.try_variant_get(x, "$.snoozeUntil", "variant").isNotNull()
        good = F.coalesce(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (F.date_format(F.try_to_date(day, "yyyy-MM-dd"), "yyyy-MM-dd") == day) & (day <= LAST_SNOOZE), F.lit(False))
        status = F.when(~(named & ~good & (part("status") == "snoozed")), part("status")).when(part("status").isNull(), None)
        return F.struct(F.when(part("status").isNotNull() & (~named | good | (part("status") != "snoozed")), status).alias("status"), part("notes").alias("notes"), F.when(good, day).alias("until"))

    read = F.map_filter(F.transform_values(raw, lambda k, x: task(x)), lambda k, t: t["status"].isNotNull() | t["notes"].isNotNull() | t["until"].isNotNull())
    fits = (F.try_variant_get(v, "$.schemaVersion", "int") == version) & raw.isNotNull()
    return F.when(F.coalesce(fits, F.lit(False)), read)


def backup_fault(text: Column, newest: str, tasks: list[str], categories: list[str]) -> Column:
    """Why a backup (JSON: backupSchema, appVersion, createdAt, stores with profile, timeline-state and calendar-sync) is turned away:
    invalid, newer, profile, timeline or calendar; null if it stands. Keys must be exactly those that are known."""
    v = F.try_parse_json(text)
    keys = lambda path, allowed: F.sort_array(F.map_keys(F.try_variant_get(v, path, "map<string,variant>"))) == F.array(*map(F.lit, sorted(allowed)))
    no = F.lit(False)
    schema = F.try_variant_get(v, "$.backupSchema", "double")
    app = F.try_variant_get(v, "$.appVersion", "string")
    shaped = F.coalesce(app.rlike(r"^(0|[1-9][0-9]{0,5})\.(0|[1-9][0-9]{0,5})\.(0|[1-9][0-9]{0,5})$"), no)
    frame = F.coalesce(keys("$", ["appVersion", "backupSchema", "createdAt", "stores"]) & (F.try_variant_get(v, "$.createdAt", "long") >= 0), no) & F.coalesce(keys("$.stores", ["calendar-sync", "profile", "timeline-state"]), no)
    day = F.try_variant_get(v, "$.stores.profile.eaos", "string")
    profile = F.coalesce(F.date_format(F.try_to_date(day, "yyyy-MM-dd"), "yyyy-MM-dd") == day, no)
    state = F.to_json(F.try_variant_get(v, "$.stores['timeline-state']", "variant"))
    named = F.map_keys(stored_tasks(state))
    timeline = (state == "null") | state.isNull() | F.coalesce(F.forall(named, lambda k: k.isin(*tasks)), no)
    lists = {"taskIds": tasks, "categories": categories}
    calendar_null = F.coalesce(F.to_json(F.try_variant_get(v, "$.stores['calendar-sync']", "variant")) == "null", F.lit(True))
    calendar = no | (F.try_variant_get(v, "$.stores['calendar-sync'].schemaVersion", "int") == 1)
    for name, known in lists.items():
        calendar = calendar & known_list(F.try_variant_get(v, f"$.stores['calendar-sync'].exclusions.{name}", "array<string>"), known).isNotNull()
    calendar = calendar_null | F.coalesce(calendar, no)
    store = F.when(~frame, "invalid").when(~profile, "profile").when(~timeline, "timeline").when(~calendar, "calendar")
    later = compared_versions(app, F.lit(newest)) > 0
    return (
        F.when(schema.isNull() | (schema != F.floor(schema)), "invalid").when(schema > 1, "newer").when((schema != 1) | ~shaped, "invalid").when(store.isNotNull() & later, "newer").otherwise(store)
    )


