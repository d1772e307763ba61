"""Recipes for known platforms' endpoints, and a first recipe from what a page's analysis found."""

from __future__ import annotations

import re

from .recipe import Extractor, Field, Recipe
from .run import unique_names

# Field name, type, path in a product (or its first variant), path in a variant with its product as parent.
SHOP_FIELDS = (
    ("title", "text", "title", "_parent.title"),
    ("variant", "text", None, "title"),
    ("price", "price", "variants[0].price", "price"),
    ("compare_at_price", "price", "variants[0].compare_at_price", "compare_at_price"),
    ("sku", "text", "variants[0].sku", "sku"),
    ("available", "bool", "variants[0].available", "available"),
    ("vendor", "text", "vendor", "_parent.vendor"),
    ("product_type", "text", "product_type", "_parent.product_type"),
    ("tags", "list", "tags[*]", "_parent.tags[*]"),
    ("image", "image", "images[0].src", "_parent.images[0].src"),
    ("url", "url", "handle", "_parent.handle"),
    ("published_at", "date", "published_at", "_parent.published_at"),
)
# Path below the API root, field name, type and path of each field.
REST = {
    "woocommerce": ("wc/store/v1/products", (("title", "text", "name"), ("price", "text", "prices.price"), ("currency", "text", "prices.currency_code"), ("sku", "text", "sku"), ("in_stock", "bool", "is_in_stock"), ("image", "image", "images[0].src"), ("url", "url", "permalink"))),
    "wordpress": ("wp/v2/posts", (("title", "text", "title.rendered"), ("url", "url", "link"), ("published_at", "date", "date"), ("excerpt", "text", "excerpt.rendered"), ("slug", "text", "slug"))),
}


def shop_fields(root: str, variants: bool = False) -> list[Field]:
    """The fields of a shop's product list, one row a product or one a variant; links are made from handles."""
    out = []
    for name, kind, product, variant in SHOP_FIELDS:
        path = variant if variants else product
        if path is not None:
            template = f"{root.rstrip('/')}/products/{{value}}" if name == "url" else None
            out.append(Field(name=name, type=kind, required=name == "title", sparse=name == "compare_at_price", extract=Extractor(json_path=f"$.{path}", all=kind == "list", template=template)))
    return out


def rest_fields(platform: str) -> list[Field]:
    return [Field(name=n, type=k, required=n == "title", extract=Extractor(json_path=f"$.{p}")) for n, k, p in REST[platform][1]]


def endpoint(platform: str, base: str, root: str | None = None, variants: bool = False) -> dict:
    """The parts of a recipe that read a platform's endpoint: list, api and fields."""
    base = base.rstrip("/")
    if platform == "shopify":
        url, size, container, fields = f"{base}/products.json?limit={{limit}}&page={{page}}", 250, "json:body.products[*]", shop_fields(root or base, variants)
    elif platform in REST:
        url, size, container, fields = f"{base}/{REST[platform][0]}?per_page=100&page={{page}}", 100, "json:body", rest_fields(platform)
    else:
        raise ValueError(f"no endpoint known for {platform!r}")
    api = {"url_template": url, "paging": {"kind": "page", "start": 1, "step": 1, "page_size": size}, "platform": platform} | ({"explode": "variants"} if variants else {})
    return {"page_type": "list", "list": {"container": container}, "api": api, "fields": [f.model_dump(exclude_none=True) for f in fields]}


def _legal(name: str) -> str:
    bare = re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")
    return (f"f{bare}" if bare[:1].isdigit() else bare or "field")[:64]


def _guess(key: str) -> str:
    from .run import json_fields

    return next((f.type for f in json_fields({key: ""})), "text")


def draft(url: str, analysis: dict, json_lists: list[dict] | None = None, detail: dict | None = None) -> Recipe:
    """A first recipe for a page: its JSON list, else its best container, else its title; then paging as found.

    detail: the vote on links to detail pages, taken where half of them stay on the host.
    """
    data: dict = {"seeds": [url], "page_type": "list"}
    containers = analysis.get("containers") or []
    if json_lists:
        names = unique_names([_legal(k) for k in json_lists[0]["keys"][:12]])
        data |= {"list": {"container": json_lists[0]["container"]}, "fields": [{"name": n, "type": _guess(k), "extract": {"json_path": f"$.{k}"}} for n, k in zip(names, json_lists[0]["keys"], strict=False)]}
    elif analysis.get("page_type") == "list" and containers:
        found = analysis["fields"] or [{"name": "title", "type": "text", "selector": "a"}]
        names = unique_names([_legal(f["name"]) for f in found])
        data |= {
            "list": {"container": containers[0]["selector"], "alternates": [c["selector"] for c in containers[1:3]]},
            "fields": [{"name": n, "type": f["type"], "required": n == "title", "examples": f.get("examples", []), "extract": {"css": f["selector"]} | ({"attr": "src"} if f["type"] == "image" else {})} for n, f in zip(names, found, strict=True)],
        }
        if detail and detail["same_host"] >= 0.5:
            data["detail"] = {"enabled": True, "link": {"css": detail["selector"]}}
    else:
        data |= {"page_type": "single", "fields": [{"name": "title", "scope": "page", "extract": {"css": "title"}}]}
    paging = {p["kind"]: p for p in reversed(analysis.get("pagination") or [])}
    chosen = paging.get("next_link") or paging.get("url_template")
    if chosen:
        data["pagination"] = chosen
    return Recipe.model_validate(data)
