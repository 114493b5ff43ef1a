"""Catalogue search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gatehouse.functions.text import contains_ci
from gatehouse.operators.filters import (
    ACTIVE, DATASET_STATUSES, date_range, for_workspace, keyword_match, optional_filters, visible, with_tag,
)
from gatehouse.operators.joins import exists_filter
from gatehouse.operators.paging import page_rows, requested_order, sort_columns
from gatehouse.operators.reports import catalogue_report
from gatehouse.operators.trigrams import gram_index, indexed_match
from gatehouse.session import materialize

KEYWORD_FIELDS = ("code", "name", "description", "category_name", "source_name", "source_type", "owner_name")


@dataclass(frozen=True)
class SearchRequest:
    """Filters, sort and page; None means no filter."""

    workspace_id: object = None
    name: str | None = None
    keyword: str | None = None
    category_id: object = None
    owner_id: object = None
    tag: str | None = None
    status: str | None = None
    created_from: object = None
    created_to: object = None
    sort_by: str | None = None
    direction: str | None = None
    page: int = 1
    size: int = 20


@dataclass(frozen=True)
class Reader:
    """Who is searching."""

    workspace_id: object = None
    is_admin: bool = False
    sees_all_statuses: bool = False


def catalog_index(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Gram indexes of the catalogue's keyword fields and of the tags' names, to be written and given to a search among its
    ``tables``."""
    rows = catalogue_report(tables["datasets"], tables["workspaces"], tables["categories"], tables["users"])
    return {"grams": gram_index(rows, "dataset_id", KEYWORD_FIELDS), "tag_grams": gram_index(tables["tags"], "tag_id", ["tag_name"])}


def catalog_matches(tables: dict[str, DataFrame], request: SearchRequest, reader: Reader) -> DataFrame:
    """All rows a search finds, before sorting and paging; cheap filters run before the joins. With ``grams`` and
    ``tag_grams`` among the tables, a keyword is looked up there first."""
    if request.workspace_id is not None and not reader.is_admin and request.workspace_id != reader.workspace_id:
        raise ValueError("Cross-workspace filtering is not allowed.")
    status = None
    if request.status and request.status.strip():
        status = {s.lower(): s for s in DATASET_STATUSES}.get(request.status.lower())
        if status is None:
            raise ValueError("Invalid dataset status. Allowed values are Draft, Active, Archived.")
    rows = for_workspace(tables["datasets"], reader.workspace_id, reader.is_admin)
    rows = visible(rows, reader.is_admin or reader.sees_all_statuses)
    rows = optional_filters(rows, {
        "workspace_id": request.workspace_id, "category_id": request.category_id, "owner_id": request.owner_id,
        "status": status,
    })
    rows = date_range(rows, "created_at", request.created_from, request.created_to)
    if request.name and request.name.strip():
        rows = rows.filter(contains_ci(F.col("name"), request.name))
    if request.tag and request.tag.strip():
        rows = with_tag(rows, request.tag, "dataset_id", tables["dataset_tags"], tables["tags"])
    rows = catalogue_report(rows, tables["workspaces"], tables["categories"], tables["users"])
    if not (request.keyword and request.keyword.strip()):
        return rows
    links = tables["dataset_tags"], tables["tags"]
    if "grams" in tables:
        return indexed_match(rows, tables["grams"], request.keyword, KEYWORD_FIELDS, "dataset_id", *links, tables.get("tag_grams"))
    return keyword_match(rows, request.keyword, KEYWORD_FIELDS, "dataset_id", *links)


def catalog_search(
    tables: dict[str, DataFrame], request: SearchRequest, reader: Reader
) -> tuple[DataFrame, DataFrame]:
    """One page of the catalogue, and a one-row total before paging.

    The search runs once, for ids and sort values, which are kept; the page and the total are taken from these, and only
    the page's datasets are read again.
    """
    order = requested_order(request.sort_by, request.direction, "dataset_id")
    keys = list(dict.fromkeys(name for name, _ in order))
    found = materialize(catalog_matches(tables, request, reader).select(*keys))
    ids = page_rows(found, order, request.page, request.size).select(F.col("dataset_id").alias("_id"))
    listed = exists_filter(tables["datasets"], ids, {"dataset_id": "_id"})
    rows = catalogue_report(listed, tables["workspaces"], tables["categories"], tables["users"])
    return rows.orderBy(*sort_columns(order)), found.agg(F.count("*").alias("total"))
