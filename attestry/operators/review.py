"""What people do to schemas and questions, as folds of their events in order: native expressions, one row for each family or lane.

An event that a state does not allow leaves it as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.scalars import strip

FIELD = "struct<field_id:string,label:string,value_type:string,required:boolean,is_column:boolean,deleted:boolean>"
NO_LABEL, NO_FIELD = "empty label", "no field left"


def ordered(events: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", *columns))).alias("_events"))


def edit_schemas(fields: DataFrame, events: DataFrame) -> DataFrame:
    """(family_id, approved, error, fields): each family's fields after its events; approval is the end, and drops deleted fields.

    fields: family_id, ord, field_id, label, value_type, required, is_column. events: family_id, seq, type, field_id, label,
    value_type; types RENAME, RETYPE, TOGGLE_REQUIRED, TOGGLE_COLUMN, DELETE, UNDO_DELETE (the last deleted field), APPROVE."""
    item = F.struct("field_id", "label", "value_type", F.coalesce("required", F.lit(False)).alias("required"), F.coalesce("is_column", F.lit(False)).alias("is_column"), F.lit(False).alias("deleted")).cast(FIELD)
    families = fields.groupBy("family_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "field_id", item.alias("f")))), lambda x: x["f"]).alias("_fields"))
    rows = families.join(ordered(events, "family_id", ["type", "field_id", "label", "value_type"]), "family_id", "left")
    nothing = F.array().cast("array<string>")
    start = F.struct(F.col("_fields").alias("fields"), nothing.alias("undo"), F.lit(False).alias("approved"), F.lit(None).cast("string").alias("error"))

    def step(acc: Column, e: Column) -> Column:
        kind, label = e["type"], F.coalesce(strip(e["label"]), F.lit(""))
        last = F.try_element_at(acc["undo"], F.lit(-1))
        target = F.when(kind == "UNDO_DELETE", last).otherwise(e["field_id"])
        live = F.exists(acc["fields"], lambda f: (f["field_id"] == target) & ~f["deleted"])
        left = F.exists(acc["fields"], lambda f: ~f["deleted"])
        refused = F.when((kind == "RENAME") & (label == ""), NO_LABEL).when((kind == "APPROVE") & ~left, NO_FIELD)
        idle = ((kind == "DELETE") & ~live) | ((kind == "UNDO_DELETE") & last.isNull())
        inert = acc["approved"] | idle | ~kind.isin("RENAME", "RETYPE", "TOGGLE_REQUIRED", "TOGGLE_COLUMN", "DELETE", "UNDO_DELETE", "APPROVE") | kind.isNull()

        def changed(f: Column) -> Column:
            flip = lambda name, event: f[name] != (kind == event)
            new = F.struct(
                f["field_id"].alias("field_id"),
                F.when(kind == "RENAME", label).otherwise(f["label"]).alias("label"),
                F.when(kind == "RETYPE", e["value_type"]).otherwise(f["value_type"]).alias("value_type"),
                flip("required", "TOGGLE_REQUIRED").alias("required"),
                flip("is_column", "TOGGLE_COLUMN").alias("is_column"),
                F.when(kind == "DELETE", True).when(kind == "UNDO_DELETE", False).otherwise(f["deleted"]).alias("deleted"),
            )
            return F.when((f["field_id"] == target) & refused.isNull(), new).otherwise(f)

        undo = F.when(kind == "DELETE", F.array_append(acc["undo"], target)).when(kind == "UNDO_DELETE", F.slice(acc["undo"], F.lit(1), F.size(acc["undo"]) - 1)).otherwise(acc["undo"])
        moved = F.struct(F.transform(acc["fields"], changed).alias("fields"), undo.alias("undo"), ((kind == "APPROVE") & refused.isNull()).alias("approved"), refused.alias("error"))
        return F.when(inert, acc).otherwise(moved)

    done = rows.select("family_id", F.aggregate(F.coalesce("_events", F.array().cast(rows.schema["_events"].dataType)), start, step).alias("s"))
    kept = F.when(F.col("s.approved"), F.filter("s.fields", lambda f: ~f["deleted"])).otherwise(F.col("s.fields"))
    return done.select("family_id", "s.approved", "s.error", kept.alias("fields"))


def review_lanes(items: DataFrame, events: DataFrame) -> DataFrame:
    """(lane_id, open, cursor, editing, actions, done): what a reviewer's keys did to each lane of questions.

    items: lane_id, ord, item_id, value. events: lane_id, seq, type (KEY, EDIT_INPUT, ACTION_DONE), key, value. One action at a
    time: while it waits for ACTION_DONE, keys do nothing. actions: struct<kind (accept, save_edit), item_id, value>."""
    lanes = items.groupBy("lane_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item_id", "value"))), lambda x: F.struct(x["item_id"].alias("item_id"), x["value"].alias("value"))).alias("_items"))
    rows = lanes.join(ordered(events, "lane_id", ["type", "key", "value"]), "lane_id", "left")
    action = "struct<kind:string,item_id:string,value:string>"
    start = F.struct(F.col("_items").alias("items"), F.lit(0).alias("cursor"), F.lit(False).alias("editing"), F.lit("").alias("draft"), F.lit(False).alias("pending"), F.array().cast(f"array<{action}>").alias("actions"))

    def step(acc: Column, e: Column) -> Column:
        state = lambda **new: F.struct(*(new.get(c, acc[c]).alias(c) for c in ("items", "cursor", "editing", "draft", "pending", "actions")))
        now, no = F.get(acc["items"], acc["cursor"]), F.lit(False)
        act = lambda kind, value: F.array_append(acc["actions"], F.struct(F.lit(kind).alias("kind"), now["item_id"].alias("item_id"), value.alias("value")).cast(action))
        rest = F.filter(acc["items"], lambda x, i: i != acc["cursor"])
        closed = state(items=rest, cursor=F.least(acc["cursor"], F.greatest(F.size(rest) - 1, F.lit(0))), editing=no, draft=F.lit(""), pending=no)
        key = F.when((e["type"] == "KEY") & ~acc["pending"], e["key"])
        return (
            F.when(F.size(acc["items"]) == 0, acc)
            .when(e["type"] == "ACTION_DONE", closed)
            .when((e["type"] == "EDIT_INPUT") & acc["editing"], state(draft=F.coalesce(e["value"], F.lit(""))))
            .when(acc["editing"] & (key == "Escape"), state(editing=no, draft=F.lit("")))
            .when(acc["editing"] & (key == "Enter"), state(pending=F.lit(True), actions=act("save_edit", acc["draft"])))
            .when(acc["editing"], acc)
            .when(key == "Enter", state(pending=F.lit(True), actions=act("accept", now["value"])))
            .when(F.lower(key) == "e", state(editing=F.lit(True), draft=F.coalesce(now["value"], F.lit(""))))
            .when(key == "ArrowDown", state(cursor=F.least(F.size(acc["items"]) - 1, acc["cursor"] + 1)))
            .when(key == "ArrowUp", state(cursor=F.greatest(F.lit(0), acc["cursor"] - 1)))
            .otherwise(acc)
        )

    done = rows.select("lane_id", F.aggregate(F.coalesce("_events", F.array().cast(rows.schema["_events"].dataType)), start, step).alias("s"))
    return done.select("lane_id", F.size("s.items").alias("open"), "s.cursor", "s.editing", "s.actions", (F.size("s.items") == 0).alias("done"))
