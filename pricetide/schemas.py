"""Schemas of raw payloads and stored tables."""

from __future__ import annotations

LISTING = """flyers array<struct<id bigint, merchant string, merchant_id bigint, name string, postal_code string,
 valid_from string, valid_to string, available_from string, available_to string, width double, height double,
 thumbnail_url string>>"""

PAYLOAD = """flyer_id bigint, pages array<struct<id bigint, page int, name string, `left` double, `right` double,
 top double, bottom double>>, items array<struct<id bigint, name string, price string, current_price string,
 original_price string, pre_price_text string, post_price_text string, description string, brand string,
 `left` double, `right` double, top double, bottom double, valid_from string, valid_to string,
 cutout_image_url string, clean_image_url string>>"""

DETAIL = """item struct<id bigint, description string, pre_price_text string, sale_story string,
 post_price_text string, brand string, clean_image_url string>"""

GRID_BATCH = """run_id string, batch_no int, adsStartDate string, adsEndDate string, flyerRunId string,
 thumbnailImageUrl string, ads array<struct<id bigint, circularId string, name string, description string,
 salesText string, price string, brand string, categories array<struct<name string>>,
 images struct<medium string, small string>>>"""

GRID_PRODUCTS = """ad_id bigint, products array<struct<name string, brand string, regularPrice double, price double,
 size string, rootCatName string, image struct<large string>>>"""

PREPARED = """flyer_id bigint, pages_items array<struct<page_number int, is_front_page boolean,
 items array<struct<name string, price double, unit_size double, unit_type string, brand string, image_url string,
 promo_type string>>>>"""

FLYERS = """flyer_id bigint, postal_code string, merchant string, name string, valid_from string, valid_to string,
 is_trusted boolean, source_type string, scraped_at string"""

PRODUCTS = """product_id bigint, canonical_name string, brand string, category string, unit_size double,
 unit_type string, last_shelf_price double, upc string"""

OBSERVATIONS = """deal_id bigint, flyer_id bigint, product_id bigint, raw_deal_id bigint, page_number int,
 is_front_page boolean, advertised_price double, unit_price double, promo_type string, promo_detail string,
 qualifying_qty int, base_price double, coupon_discount double, ad_title string, raw_title string,
 image_url string, is_trusted boolean, source_type string, recorded_at string"""

COUPONS = """coupon_id bigint, coupon_key string, title string, description string, coupon_type string,
 discount_amount double, min_spend double, category string, eligible_brand string, is_clipped boolean,
 valid_to string, raw_node_text string, account_email string, scraped_at string"""

STACKS = """stack_id bigint, product_name string, category string, retail_price double, source_type string,
 store_coupon_discount double, mfg_coupon_discount double, final_out_of_pocket double, is_clipped boolean,
 coupon_references string, account_email string, created_at string"""

RATINGS = "product_key string, rating string"

DEAL_COLUMNS = [
    "raw_deal_id", "flyer_id", "page_number", "is_front_page", "canonical_name", "brand", "advertised_price",
    "unit_size", "unit_type", "unit_price", "raw_title", "image_url", "promo_type", "is_trusted", "source_type",
    "category", "promo_detail", "qualifying_qty", "base_price", "coupon_discount", "ad_title",
]
