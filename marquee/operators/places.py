"""Joins that put listings on the map, and the lookups around them.

No side is broadcast by hint. Dimension tables are small and Spark broadcasts them by their measured size; where
one is too large the same join runs shuffled, and AQE splits hot keys on the listing side.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee import vocab
from marquee.functions.geo import canonical_place, crossings, edges, geocode_key, mean_point, park_key, street_key
from marquee.functions.text import folded
from marquee.lineage import settled
from marquee.operators.ordering import stored_matches
from marquee.operators.predicates import runs_on_or_after


def with_neighborhood(ev: DataFrame, nb: DataFrame, how: str = "left") -> DataFrame:
    names = nb.select(F.col("id").alias("neighborhood_id"), F.col("name").alias("neighborhood"))
    return ev.join(names, "neighborhood_id", how)


def boundary_cells(boundaries: DataFrame, cell: float) -> DataFrame:
    """(cx, cy, candidates): per grid cell the polygons that reach into it, in boundary order, and of each ring only what the cell needs.

    `boundaries` has (ord, name, polygon). Whether a point is in a ring is the parity of the edges a ray to the right crosses. For the
    points of a cell these are

    * `edges`: those with a column and a row in common with the cell, tested exactly;
    * edges wholly in columns further right, whose parity telescopes: what counts is, for each edge that leads from this column or one before
      it to one further right, whether its right end is above the point. Ends in rows above the cell are counted in `flips`, ends in
      its row are listed in `turns`, ends below count for nothing.

    So a cell inside a ring away from its border holds one number, and no cell holds a ring.
    """
    def at(value: str) -> str:
        return f"floor({value} / {cell!r}D)"

    numbered = boundaries.where(F.size("polygon") > 0).withColumn("pid", F.monotonically_increasing_id())  # before the rings are dealt out
    rings = numbered.select("pid", "ord", "name", F.posexplode("polygon").alias("ring", "points"))
    edged = rings.select("pid", "ord", "name", "ring", F.expr(f"array_min(transform(points, p -> {at('p.y')}))").alias("low"), F.explode(edges(F.col("points"))).alias("e"))
    placed = edged.selectExpr(
        "*", f"least({at('e.x1')}, {at('e.x2')}) AS c1", f"greatest({at('e.x1')}, {at('e.x2')}) AS c2", f"least({at('e.y1')}, {at('e.y2')}) AS r1",
        f"greatest({at('e.y1')}, {at('e.y2')}) AS r2", "IF(e.x2 > e.x1, e.y2, e.y1) AS end").withColumn("row", F.expr(at("end")))
    none = "CAST(array() AS array<struct<cx:bigint,cy:bigint,edge:struct<x1:double,y1:double,x2:double,y2:double>,turn:double,flip:int>>)"
    no_edge, columns = "CAST(NULL AS struct<x1:double,y1:double,x2:double,y2:double>)", "sequence(c1, c2 - 1)"

    def record(cx: str, cy: str, edge: str = no_edge, turn: str = "CAST(NULL AS double)", flip: int = 0) -> str:
        return f"named_struct('cx', {cx}, 'cy', {cy}, 'edge', {edge}, 'turn', {turn}, 'flip', {flip})"

    crossed = f"IF(e.y1 <> e.y2, flatten(transform(sequence(c1, c2), i -> transform(sequence(r1, r2), j -> {record('i', 'j', 'e')}))), {none})"
    turns = f"IF(c2 > c1, transform({columns}, i -> {record('i', 'row', turn='end')}), {none})"
    flips = f"IF(c2 > c1 AND row > low, flatten(transform({columns}, i -> transform(sequence(low, row - 1), j -> {record('i', 'j', flip=1)}))), {none})"
    parts = placed.select("pid", "ord", "name", "ring", F.explode(F.expr(f"concat({crossed}, {turns}, {flips})")).alias("p"))
    of_ring = parts.groupBy("pid", "ord", "name", "ring", "p.cx", "p.cy").agg(
        F.struct((F.sum("p.flip") % 2).alias("flips"), F.collect_list("p.turn").alias("turns"), F.collect_list("p.edge").alias("edges")).alias("r"))
    matters = "(r.flips = 1 OR size(r.turns) > 0 OR size(r.edges) > 0)"
    of_polygon = of_ring.groupBy("pid", "ord", "name", "cx", "cy").agg(
        F.expr(f"first(IF(ring = 0 AND {matters}, r, NULL), true)").alias("outer"),
        F.expr(f"collect_list(IF(ring > 0 AND {matters}, r, NULL))").alias("holes")).where("outer IS NOT NULL")
    return of_polygon.groupBy("cx", "cy").agg(
        F.sort_array(F.collect_list(F.struct("ord", "name", "outer", "holes"))).alias("candidates"))


def point_in_polygon(points: DataFrame, boundaries: DataFrame, x: str = "longitude", y: str = "latitude",
                     out: str = "neighborhood", cell: float = 0.01) -> DataFrame:
    """Every point with the first boundary that contains it, null outside all of them.

    Equi-join on the grid cell, then the exact test in the row, on the few edges of the cell: each point comes out once, so there is no
    theta join and nothing to regroup.
    """
    px, py = F.col(x), F.col(y)
    located = points.withColumns({"_cx": F.floor(px / F.lit(cell)), "_cy": F.floor(py / F.lit(cell))})
    cells = boundary_cells(boundaries, cell).withColumnsRenamed({"cx": "_cx", "cy": "_cy"})

    def inside(ring: Column) -> Column:
        above = F.size(F.filter(ring["turns"], lambda turn: turn > py))
        return (ring["flips"] + above + crossings(px, py, ring["edges"])) % 2 == 1

    hit = F.get(F.filter("candidates", lambda c: inside(c["outer"]) & ~F.exists(c["holes"], inside)), F.lit(0))["name"]
    return located.join(cells, ["_cx", "_cy"], "left").withColumn(out, hit).drop("_cx", "_cy", "candidates")


def load_boundaries(features: DataFrame, aliases=vocab.BOUNDARY_ALIASES) -> DataFrame:
    """Landed features as boundary rows: fine areas folded into known names, one row per polygon.

    A name may own many polygons; they stay rows (name, ord, polygon), which is what point_in_polygon reads.
    """
    name = canonical_place(canonical_place("name", aliases))
    rows = features.where(name.isNotNull() & F.col("polygons").isNotNull())
    return rows.select(name.alias("name"), "ord", F.explode("polygons").alias("polygon"))


def boundary_report(boundaries: DataFrame, nb: DataFrame) -> DataFrame:
    """Per name, what was loaded and whether the neighborhood is new."""
    points = F.aggregate("polygon", F.lit(0), lambda n, r: n + F.size(r))
    loaded = boundaries.groupBy("name").agg(F.count("*").alias("polygons"), F.sum(points).alias("points"))
    known = nb.select("name", F.lit(True).alias("known"))
    status = F.when(F.col("polygons").isNull(), "unchanged").when(F.col("known"), "updated").otherwise("created")
    return loaded.join(known, "name", "full").select(
        "name", F.coalesce("polygons", F.lit(0)).alias("polygons"), F.coalesce("points", F.lit(0)).alias("points"),
        status.alias("status"))


def polygon_centroid(geometries: DataFrame) -> DataFrame:
    at = mean_point("polygons")
    return geometries.withColumns({"longitude": at["x"], "latitude": at["y"]})


def place_by_park(ev: DataFrame, parks: DataFrame, boundaries: DataFrame, cell: float = 0.01) -> DataFrame:
    """Listings placed by the park their address, else their venue name, matches.

    `parks` has (ord, label, park, location, polygons); the first park to claim a key keeps it.
    """
    centred = polygon_centroid(parks).where(F.col("longitude").isNotNull())
    spot = F.struct("longitude", "latitude")
    by_address = centred.where(F.col("location") != "").groupBy(street_key("location").alias("_address_key")).agg(
        F.min_by(spot, "ord").alias("_by_address"))
    named = centred.select("ord", spot.alias("_spot"), F.posexplode(F.array("label", "park")).alias("_field", "_name"))
    by_name = named.where(F.col("_name") != "").groupBy(park_key("_name").alias("_name_key")).agg(
        F.min_by("_spot", F.struct("ord", "_field")).alias("_by_name"))
    keyed = ev.withColumns({"_address_key": street_key("address"), "_name_key": F.when(
        F.col("venue_name") != "", park_key("venue_name"))})
    found = keyed.join(by_address, "_address_key", "left").join(by_name, "_name_key", "left")
    at = F.coalesce("_by_address", "_by_name")
    found = found.withColumns({"_x": at["longitude"], "_y": at["latitude"]}).drop(
        "_address_key", "_name_key", "_by_address", "_by_name")
    placed = point_in_polygon(found, boundaries, "_x", "_y", cell=cell)
    status = F.when(F.col("_x").isNull(), "unmatched").when(F.col("neighborhood").isNull(), "outside").otherwise("placed")
    inside = status == "placed"
    return placed.withColumns({
        "status": status,
        "longitude": F.when(inside & F.col("latitude").isNull(), F.col("_x")).otherwise(F.col("longitude")),
        "latitude": F.when(inside & F.col("latitude").isNull(), F.col("_y")).otherwise(F.col("latitude")),
    }).drop("_x", "_y")


def geocode_lookup(ev: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached coordinates of a listing's address. A stored miss is an answer: it is not to be asked again."""
    known = cache.select(F.col("query").alias("geocode_key"), F.col("latitude").alias("cached_latitude"),
                         F.col("longitude").alias("cached_longitude"), F.col("resolved").alias("_resolved"))
    out = ev.withColumn("geocode_key", geocode_key("address", "venue_name")).join(known, "geocode_key", "left")
    hit = F.col("_resolved") & F.col("cached_latitude").isNotNull()
    state = F.when(F.col("geocode_key").isNull(), "not_a_place").when(F.col("_resolved").isNull(), "unknown").when(
        hit, "hit").otherwise("known_miss")
    return out.withColumns({
        "geocode_state": state,
        "cached_latitude": F.when(hit, F.col("cached_latitude")),
        "cached_longitude": F.when(hit, F.col("cached_longitude"))}).drop("_resolved")


def geocode_worklist(ev: DataFrame, cache: DataFrame) -> DataFrame:
    """Every key an outside geocoder would be asked, once."""
    keys = ev.select(geocode_key("address", "venue_name").alias("query")).where("query IS NOT NULL").distinct()
    return keys.join(cache.select("query"), "query", "left_anti")


def venue_to_neighborhood(config: DataFrame) -> DataFrame:
    """First configured neighborhood per lower-cased venue name."""
    return config.groupBy(folded("name").alias("venue_key")).agg(
        F.min_by(canonical_place("neighborhood"), F.col("id")).alias("neighborhood"))


def resolve_neighborhood(ev: DataFrame, boundaries: DataFrame, venue_map: DataFrame, cache: DataFrame,
                         cell: float = 0.01) -> DataFrame:
    """Where unplaced listings are: by their own point, else by their venue, else by their geocoded address.

    The cache is placed on the map once, before the join, instead of once per listing.
    """
    todo = ev.where(F.col("neighborhood_id").isNull())
    own = point_in_polygon(todo, boundaries, out="_own", cell=cell)
    venues = venue_map.select(F.col("venue_key").alias("_venue_key"), F.col("neighborhood").alias("_venue"))
    mapped = own.withColumn("_venue_key", folded("venue_name")).join(venues, "_venue_key", "left").drop("_venue_key")
    placed_cache = point_in_polygon(cache, boundaries, out="_place", cell=cell)
    looked = geocode_lookup(mapped, placed_cache)
    looked = looked.join(placed_cache.select(F.col("query").alias("geocode_key"), "_place"), "geocode_key", "left")
    hit = F.col("geocode_state") == "hit"
    settled = F.col("_own").isNotNull() | F.col("_venue").isNotNull()
    use_cache = ~settled & hit
    how = F.when(F.col("_own").isNotNull(), "coordinates").when(F.col("_venue").isNotNull(), "venue").when(
        use_cache & F.col("_place").isNotNull(), "geocoded").when(
        use_cache | F.col("latitude").isNotNull(), "outside").otherwise("unknown")
    take = use_cache & F.col("latitude").isNull()
    return looked.withColumns({
        "neighborhood": F.coalesce("_own", "_venue", F.when(use_cache, F.col("_place"))),
        "how": how,
        "longitude": F.when(take, F.col("cached_longitude")).otherwise(F.col("longitude")),
        "latitude": F.when(take, F.col("cached_latitude")).otherwise(F.col("latitude")),
    }).drop("_own", "_venue", "_place", "geocode_key", "geocode_state", "cached_latitude", "cached_longitude")


def dense_ids(df: DataFrame, key: str, start: Column, out: str = "id") -> DataFrame:
    """Consecutive ids after `start` for rows with a unique key.

    Rows are numbered inside 4096 hash blocks and each block is shifted by the rows of the blocks before it, so
    only 4096 counts ever meet in one task.
    """
    block = F.coalesce(F.substring(F.md5(F.col(key).cast("string")), 1, 3), F.lit(""))
    blocked = df.withColumn("_block", block)
    local = blocked.withColumn("_n", F.row_number().over(Window.partitionBy("_block").orderBy(key)))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocked.groupBy("_block").agg(F.count("*").alias("_c")).select(
        "_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    return local.join(offsets, "_block").withColumn(out, start + F.col("_o") + F.col("_n")).drop("_block", "_n", "_o")


def get_or_create_dim(names: DataFrame, nb: DataFrame, aliases=vocab.PLACE_ALIASES) -> DataFrame:
    """The neighborhood row of every name; a name not seen before gets the next id."""
    wanted = names.select(canonical_place("name", aliases).alias("name")).where("name IS NOT NULL").distinct()
    tagged = settled(wanted.join(nb.select("name", "id"), "name", "left"))
    existing = tagged.where(F.col("id").isNotNull()).withColumn("is_new", F.lit(False))
    highest = nb.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    created = dense_ids(tagged.where(F.col("id").isNull()).drop("id"), "name", highest).withColumn("is_new", F.lit(True))
    return existing.unionByName(created)


def match_existing(batch: DataFrame, ev: DataFrame, keys) -> DataFrame:
    """A batch with the id of the stored listing each row is about, null when it is new or a key is null."""
    keys = list(keys)
    stored = stored_matches(ev.select("id", *keys), batch, keys).groupBy(*keys).agg(F.min("id").alias("existing_id"))
    return batch.join(stored, keys, "left")


def prune_dead(ev: DataFrame, checks: DataFrame, as_of) -> DataFrame:
    """The catalogue without upcoming listings whose page was gone at every check, two checks at least."""
    dead = checks.groupBy(F.col("url").alias("origination_url")).agg(
        F.count("*").alias("n"), F.count_if(F.col("code").isin(vocab.GONE_CODES)).alias("gone")).where("n >= 2 AND gone = n")
    doomed = ev.where(F.col("origination_url").startswith("http") & runs_on_or_after(as_of)).select(
        "id", "origination_url").join(dead, "origination_url", "left_semi")
    return ev.join(doomed.select("id"), "id", "left_anti")


def transit_hint(ev: DataFrame, transit: DataFrame) -> DataFrame:
    return ev.join(transit.select("neighborhood", "transit"), "neighborhood", "left")
