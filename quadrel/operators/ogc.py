"""Service documents as relations of text fragments and joined documents.

A layer table has name, kind, w, s, e, n (degrees) and max_zoom. Fragments are made by
column expressions, one row for each layer; a document is their ordered concatenation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.functions import grid

TOP_ZOOM = 22


def rasters(layers: DataFrame) -> DataFrame:
    """Layers that map services list."""
    return layers.where("kind = 'raster'")


def metres(layers: DataFrame) -> DataFrame:
    """Adds x0, y0, x1, y1: the extent in Mercator metres."""
    return layers.withColumns({"x0": grid.lng_merc(F.col("w")), "y0": grid.lat_merc(F.col("s")), "x1": grid.lng_merc(F.col("e")), "y1": grid.lat_merc(F.col("n"))})


def union_extent(layers: DataFrame) -> DataFrame:
    """Bounds of all raster layers; no row values where there are none."""
    return rasters(layers).agg(F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"))


def escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def wms_layer(layers: DataFrame) -> DataFrame:
    """name, xml: the Layer element of each raster."""
    deg = lambda c: F.format_string("%.10f", c)
    met = lambda c: F.format_string("%.5f", c)
    name = escape(F.col("name"))
    box = F.concat(*[p for tag, c in (("westBoundLongitude", "w"), ("eastBoundLongitude", "e"), ("southBoundLatitude", "s"), ("northBoundLatitude", "n")) for p in (F.lit(f"<{tag}>"), deg(c), F.lit(f"</{tag}>"))])
    bound = F.concat(*[p for a, c in (("minx", "x0"), ("miny", "y0"), ("maxx", "x1"), ("maxy", "y1")) for p in (F.lit(f' {a}="'), met(c), F.lit('"'))])
    xml = F.concat(
        F.lit("<Layer><Name>"), name, F.lit("</Name><Title>"), name, F.lit("</Title><CRS>EPSG:3857</CRS><EX_GeographicBoundingBox>"), box,
        F.lit('</EX_GeographicBoundingBox><BoundingBox CRS="EPSG:3857"'), bound, F.lit("/><MinScaleDenominator>0.0</MinScaleDenominator><MaxScaleDenominator>1e12</MaxScaleDenominator></Layer>"),
    )
    return metres(rasters(layers)).select("name", xml.alias("xml"))


def wms_capabilities(layers: DataFrame, title: str = "Tiles", url: str = "http://localhost:8080/ogc/wms") -> str:
    """The WMS 1.3.0 capabilities document; the catalogue's fragments meet on the driver."""
    e = union_extent(layers).first()
    box = "" if e["w"] is None else f"<EX_GeographicBoundingBox><westBoundLongitude>{e['w']:.10f}</westBoundLongitude><eastBoundLongitude>{e['e']:.10f}</eastBoundLongitude><southBoundLatitude>{e['s']:.10f}</southBoundLatitude><northBoundLatitude>{e['n']:.10f}</northBoundLatitude></EX_GeographicBoundingBox>"
    parts = "".join(r["xml"] for r in wms_layer(layers).orderBy("name").toLocalIterator())
    link = f'<DCPType><HTTP><Get><OnlineResource xmlns:xlink="http://www.w3.org/1999/xlink" xlink:href="{url}"/></Get></HTTP></DCPType>'
    ops = f"<GetCapabilities><Format>text/xml</Format>{link}</GetCapabilities><GetMap><Format>image/png</Format>{link}</GetMap>"
    return (
        f'<?xml version="1.0" encoding="UTF-8"?><WMS_Capabilities version="1.3.0" xmlns="http://www.opengis.net/wms"><Service><Name>WMS</Name><Title>{title}</Title></Service>'
        f"<Capability><Request>{ops}</Request><Exception><Format>XML</Format><Format>INIMAGE</Format><Format>BLANK</Format></Exception><Layer><Title>{title}</Title><CRS>EPSG:3857</CRS>{box}{parts}</Layer></Capability></WMS_Capabilities>"
    )


def tile_matrices(spark) -> DataFrame:
    """Zooms 0 to 22: z, matrix_width, resolution, scale."""
    z = F.col("z")
    rows = spark.range(TOP_ZOOM + 1).select(F.col("id").cast("int").alias("z"))
    return rows.select("z", grid.pow2(z).cast("long").alias("matrix_width"), grid.resolution(z).alias("resolution"), grid.scale_denominator(z).alias("scale"))


def wmts_capabilities(layers: DataFrame, url: str = "http://localhost:8080/ogc/wmts") -> str:
    """The WMTS capabilities document: raster layers and the standard grid."""
    sets = "".join(
        f"<TileMatrix><Identifier>{r.z}</Identifier><ScaleDenominator>{r.scale!r}</ScaleDenominator><TopLeftCorner>{-grid.HALF} {grid.HALF}</TopLeftCorner><TileWidth>256</TileWidth><TileHeight>256</TileHeight><MatrixWidth>{r.matrix_width}</MatrixWidth><MatrixHeight>{r.matrix_width}</MatrixHeight></TileMatrix>"
        for r in tile_matrices(layers.sparkSession).orderBy("z").collect()
    )
    name = escape(F.col("name"))
    corner = lambda a, b: F.concat(F.format_string("%.10f", a), F.lit(" "), F.format_string("%.10f", b))
    xml = F.concat(F.lit("<Layer><Title>"), name, F.lit("</Title><WGS84BoundingBox><LowerCorner>"), corner("w", "s"), F.lit("</LowerCorner><UpperCorner>"), corner("e", "n"), F.lit(f'</UpperCorner></WGS84BoundingBox><Identifier>'), name, F.lit(f'</Identifier><Style isDefault="true"><Identifier>default</Identifier></Style><Format>image/png</Format><TileMatrixSetLink><TileMatrixSet>WebMercatorQuad</TileMatrixSet></TileMatrixSetLink><ResourceURL format="image/png" resourceType="tile" template="{url}/'), name, F.lit('/{TileMatrix}/{TileCol}/{TileRow}"/></Layer>'))
    parts = "".join(r["xml"] for r in rasters(layers).select("name", xml.alias("xml")).orderBy("name").toLocalIterator())
    return f'<?xml version="1.0" encoding="UTF-8"?><Capabilities xmlns="http://www.opengis.net/wmts/1.0" xmlns:ows="http://www.opengis.net/ows/1.1" version="1.0.0"><Contents>{parts}<TileMatrixSet><Identifier>WebMercatorQuad</Identifier><SupportedCRS>urn:ogc:def:crs:EPSG::3857</SupportedCRS>{sets}</TileMatrixSet></Contents></Capabilities>'


def tms_sets(layers: DataFrame, url: str = "http://localhost:8080/ogc/tms/1.0.0") -> DataFrame:
    """A row for each raster and zoom up to its own: name, z, units_per_pixel, href."""
    z = F.explode(F.sequence(F.lit(0), F.least(F.col("max_zoom"), F.lit(TOP_ZOOM))))
    rows = rasters(layers).select("name", z.alias("z"))
    return rows.select("name", "z", F.format_string("%.10f", grid.resolution(F.col("z"))).alias("units_per_pixel"), F.concat(F.lit(url + "/"), "name", F.lit("/"), F.col("z").cast("string")).alias("href"))


def tms_layer(layers: DataFrame, url: str = "http://localhost:8080/ogc/tms/1.0.0") -> DataFrame:
    """name, xml: the TileMap document of each raster."""
    one = F.concat(F.lit('<TileSet href="'), escape(F.col("href")), F.lit('" units-per-pixel="'), "units_per_pixel", F.lit('" order="'), F.col("z").cast("string"), F.lit('"/>'))
    sets = tms_sets(layers, url).groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", one.alias("x")))), lambda s: s["x"]), "").alias("sets"))
    met = lambda c: F.format_string("%.5f", c)
    name = escape(F.col("name"))
    xml = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><TileMap version="1.0.0" xmlns="http://tms.osgeo.org/1.0.0"><Title>'), name, F.lit("</Title><Abstract>TMS layer for "), name, F.lit('</Abstract><SRS>EPSG:3857</SRS><BoundingBox minx="'), met("x0"), F.lit('" miny="'), met("y0"), F.lit('" maxx="'), met("x1"), F.lit('" maxy="'), met("y1"), F.lit(f'"/><Origin x="{-grid.HALF}" y="{-grid.HALF}"/><TileFormat width="256" height="256" mime-type="image/png" extension="png"/><TileSets>'), "sets", F.lit("</TileSets></TileMap>"))
    return metres(rasters(layers)).join(sets, "name").select("name", xml.alias("xml"))


def tms_root(layers: DataFrame, url: str = "http://localhost:8080/ogc/tms/1.0.0") -> str:
    """The TMS service document: a TileMap for each raster, in the global-mercator profile."""
    name = escape(F.col("name"))
    xml = F.concat(F.lit('<TileMap title="'), name, F.lit(f'" srs="EPSG:3857" profile="global-mercator" href="{url}/'), name, F.lit('"/>'))
    parts = "".join(r["xml"] for r in rasters(layers).select("name", xml.alias("xml")).orderBy("name").toLocalIterator())
    return f'<?xml version="1.0" encoding="UTF-8"?><TileMapService version="1.0.0" xmlns="http://tms.osgeo.org/1.0.0"><Title>Tiles</Title><TileMaps>{parts}</TileMaps></TileMapService>'


def _in_json(text: Column) -> Column:
    """A text as it stands between the quotes of a JSON string."""
    whole = F.to_json(F.struct(text.alias("v")))  # {"v":"..."}
    return whole.substr(F.lit(7), F.length(whole) - 8)


def tilejson(layers: DataFrame, base: str = "http://localhost:8080") -> DataFrame:
    """name, json: TileJSON 3.0.0 of each layer, numbers with 6 digits."""
    num = lambda c: F.format_string("%.6f", c)
    raster = F.col("kind") == "raster"
    name = _in_json(F.col("name"))
    fmt = F.when(raster, "png").otherwise("geojson")
    zoom = F.floor(F.col("max_zoom") / 2).cast("string")  # from zoom 0
    json = F.concat(
        F.lit('{"tilejson":"3.0.0","name":"'), name, F.lit('","description":"'), "kind", F.lit(" tile layer for "), name, F.lit('","version":"1.0.0","attribution":"","scheme":"xyz","tiles":["'),
        F.lit(f"{base}/api/tiles/"), name, F.lit("/"), fmt, F.lit('/{z}/{x}/{y}"],"minzoom":0,"maxzoom":'), F.col("max_zoom").cast("string"),
        F.lit(',"bounds":['), F.concat_ws(",", num("w"), num("s"), num("e"), num("n")), F.lit('],"center":['), F.concat_ws(",", num((F.col("w") + F.col("e")) / 2), num((F.col("s") + F.col("n")) / 2), zoom),
        F.lit('],"format":"'), fmt, F.lit('","type":"'), "kind", F.lit('"}'),
    )
    return layers.select("name", json.alias("json"))


TEMPLATES = ["/api/tiles/{filename}/info", "/api/tiles/{filename}/png/{z}/{x}/{y}", "/api/tiles/{filename}/webp/{z}/{x}/{y}", "/api/tiles/{filename}/geojson/{z}/{x}/{y}"]


def api_paths(layers: DataFrame) -> DataFrame:
    """A concrete path for each layer and each template of its kind: path, name, operation_id."""
    from quadrel.functions import paths

    rows = layers.withColumn("template", F.explode(F.array(*map(F.lit, TEMPLATES))))
    of = lambda kind: F.col("template").contains(f"/{kind}/")
    ok = ~((of("png") | of("webp")) & (F.col("kind") != "raster")) & ~(of("geojson") & (F.col("kind") != "vector"))
    base = F.when(of("png"), "get_raster_tile").when(of("webp"), "get_raster_tile_webp").when(F.col("template").contains("/geojson/"), "get_vector_tile").otherwise("get_tile_info")
    return rows.where(ok).select(F.replace("template", F.lit("{filename}"), F.col("name")).alias("path"), "name", paths.operation_id(base, F.col("name")).alias("operation_id"))


#: Routes of the service that are not about one file: method, path, operation, summary.
ROUTES = [
    ("get", "/health", "health", "Whether the service runs"),
    ("get", "/api/sources", "list_sources", "Mounted sources"),
    ("get", "/api/geo-files", "list_geo_files", "Names, paths and kinds of all sources"),
    ("post", "/api/mount", "mount", "Mount a file"),
    ("delete", "/api/unmount/{name}", "unmount", "Unmount a source"),
    ("post", "/api/batch-tiles", "batch_tiles", "Render several tiles"),
]
_TYPES = {"png": "image/png", "webp": "image/webp", "geojson": "application/geo+json"}


def openapi(layers: DataFrame, title: str = "Tiles", version: str = "1.0.0", base: str = "http://localhost:8080") -> str:
    """The OpenAPI 3.0 document: the service's own routes and a concrete path for each source."""
    import json
    import re

    def operation(name: str, summary: str, path: str, kind: str) -> dict:
        numbers = {"z", "x", "y"}
        params = [{"name": p, "in": "path", "required": True, "schema": {"type": "integer" if p in numbers else "string"}} for p in re.findall(r"{(\w+)}", path)]
        return {"operationId": name, "summary": summary, "parameters": params, "responses": {"200": {"description": "OK", "content": {kind: {}}}, "404": {"description": "Not found"}}}

    found: dict[str, dict] = {}
    for method, path, name, summary in ROUTES:
        found.setdefault(path, {})[method] = operation(name, summary, path, "application/json")
    for r in api_paths(layers).orderBy("path").toLocalIterator():
        kind = next((t for k, t in _TYPES.items() if f"/{k}/" in r.path), "application/json")
        found.setdefault(r.path, {})["get"] = operation(r.operation_id, r.name, r.path[len(f"/api/tiles/{r.name}") :], kind)
    return json.dumps({"openapi": "3.0.3", "info": {"title": title, "version": version}, "servers": [{"url": base}], "paths": found}, ensure_ascii=False)


def base_url(host: Column) -> Column:
    """Address that documents name, from a request's Host header."""
    return F.concat(F.lit("http://"), F.coalesce(F.when(F.trim(host) != "", F.trim(host)), F.lit("localhost:8080")))


def check_map_request(params: Column) -> Column:
    """ok, or the code of what is wrong with a WMS GetMap request; params: a map of text by any-case keys."""
    p = F.transform_keys(params, lambda k, _: F.upper(k))
    get = lambda k: F.element_at(p, k)
    box = F.transform(F.split(get("BBOX"), ","), lambda s: F.trim(s).try_cast("double"))
    side = lambda k: get(k).try_cast("int")
    crs = F.upper(F.coalesce(get("CRS"), get("SRS")))
    bad = lambda c: F.coalesce(c, F.lit(True))
    return (
        F.when(bad(F.upper(get("SERVICE")) != "WMS"), "InvalidService")
        .when(bad(F.lower(get("REQUEST")) != "getmap"), "OperationNotSupported")
        .when(bad(F.trim(F.split(get("LAYERS"), ",")[0]) == ""), "LayerNotDefined")
        .when(bad(~crs.isin("EPSG:3857", "EPSG:900913")), "InvalidCRS")
        .when(bad((F.size(box) != 4) | F.exists(box, lambda v: v.isNull())), "InvalidBBox")
        .when(bad(~side("WIDTH").between(1, 4096) | ~side("HEIGHT").between(1, 4096)), "InvalidDimensionValue")
        .otherwise("ok")
    )


def exception_xml(code: str, text: str) -> str:
    from xml.sax.saxutils import escape as esc
    from xml.sax.saxutils import quoteattr

    return f'<?xml version="1.0" encoding="UTF-8"?><ServiceExceptionReport version="1.3.0" xmlns="http://www.opengis.net/ogc"><ServiceException code={quoteattr(code)}>{esc(text)}</ServiceException></ServiceExceptionReport>'
