"""The lead index as functions that return DataFrames: meta, summary, table, tile, towns, locate, export (SNK-08)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters, geo, text
from ..operators import clustering, facets, paging, sampling

STATUSES = ["verified", "unresolved", "directory", "unreachable", "unchecked", "rejected", "no_website"]


class LeadIndex:
    """Leads ``(venue_id, name, status, category, region, province, municipality, stage, lon, lat, website, phone, next_on)``."""

    def __init__(self, leads: DataFrame):
        place = F.create_map(*[F.lit(x) for i, s in enumerate(STATUSES) for x in (s, i)])
        self.leads = leads.withColumns({"name_fold": text.words_only(F.col("name")), "search": text.fold_latin(F.concat_ws(" ", "name", "municipality")), "status_ord": F.try_element_at(place, F.col("status"))})

    def rule(self, status=None, category=None, region=None, province=None, query="", has_phone=None, stage=None, due=None, today=None, leave_out="") -> Column:
        """The conjunction of the criteria given, but for the facet left out (FLT-01, FLT-02, FLT-05)."""
        one = lambda name, codes: None if not codes or leave_out == name else F.col(name).isin(codes)
        return filters.all_of([
            one("status", status), one("category", category), one("region", region), one("province", province), one("stage", stage),
            F.contains("search", text.fold_latin(F.lit(query))) if query else None,
            None if has_phone is None else F.col("phone").isNotNull() == has_phone,
            filters.due(due, F.col("next_on"), F.lit(today).cast("date"), F.col("stage").isNotNull()) if due else None,
        ])

    def meta(self) -> DataFrame:
        return facets.counts_by_each(self.leads, ["region", "province", "status", "category", "stage"])

    def summary(self, box: tuple[float, float, float, float] | None = None, **criteria) -> DataFrame:
        """Counts of status, category and stage, each without its own filter (AGG-01)."""
        every = {name: self.rule(**{k: v for k, v in criteria.items() if k == name}) for name in ("status", "category", "stage")}
        rest = self.rule(**{k: v for k, v in criteria.items() if k not in every})
        view = filters.inside(F.col("lon"), F.col("lat"), box) if box else None
        return facets.self_excluding_facets(self.leads.where(rest), every, view=view)

    def table(self, sort: str = "status_ord", descending: bool = False, offset: int = 0, size: int = 50, **criteria) -> DataFrame:
        rows = self.leads.where(self.rule(**criteria))
        ties = ["name_fold", "venue_id"] if sort != "name_fold" else ["venue_id"]
        return paging.with_total(paging.page(rows, paging.ordering(sort, descending, ties), offset, size), rows)

    def tile(self, zoom: int, x: int, y: int, **criteria) -> DataFrame:
        """Counts on a fixed grid in one tile of the map."""
        points = self.leads.where(self.rule(**criteria)).select(geo.mercator_x(F.col("lon")).alias("x"), geo.mercator_y(F.col("lat")).alias("y"), (F.col("status") == "verified").alias("flagged"))
        return clustering.tile_items(clustering.grid_clusters(points, zoom).withColumn("zoom", F.lit(clustering.level_of(zoom))), zoom, x, y)

    def towns(self, most: int = 500) -> DataFrame:
        """Towns by size, whether there are more in ``truncated`` (AGG-22, SRT-08)."""
        boxes = facets.bounds(self.leads, ["municipality", "province"], "lon", "lat")
        first = paging.page(boxes, [F.desc("n"), F.asc("municipality"), F.asc("province")], 0, most, most)
        return first.withColumn("truncated", boxes.agg(F.count("*")).scalar() > most)

    def locate(self, town: str, province: str = "") -> DataFrame:
        """The largest town of that name (SRT-09)."""
        rows = self.leads.where((text.words_only(F.col("municipality")) == text.words_only(F.lit(town))) & (F.lit(province == "") | (F.col("province") == province)))
        return facets.bounds(rows, ["municipality", "province"], "lon", "lat").orderBy(F.desc("n"), "municipality", "province").limit(1)

    def find(self, query: str) -> DataFrame:
        return paging.prefix_search(self.leads, "name_fold", query, ["venue_id"])

    def export(self, sample: int = 0, seed: str = "", **criteria) -> DataFrame:
        """The selection as CSV lines in list order, or a reproducible sample of it in hash order (SNK-02, SMP-01)."""
        rows = self.leads.where(self.rule(**criteria))
        columns = ["venue_id", "name", "status", "category", "region", "province", "municipality", "lat", "lon", "website", "phone"]
        ordered = sampling.hash_sample(rows, "venue_id", sample, seed) if sample else rows.orderBy("status_ord", "name_fold", "venue_id")
        return ordered.select(text.csv_line([F.col(c) for c in columns]).alias("line"))
