"""Names, bounds and constants that decide what results look like."""

# Columns behind the sales summaries and the forecast.
SALES_COLUMNS = (
    "truck_brand_name",
    "menu_type",
    "price",
    "city",
    "item_category",
    "item_subcategory",
    "order_total",
    "order_ts",
)

# Columns behind the site scores and the item profits.
GEO_COLUMNS = (
    "latitude",
    "longitude",
    "price",
    "menu_type",
    "item_category",
    "city",
    "order_ts",
    "unit_price",
    "menu_item_name",
    "cost_of_goods_usd",
    "quantity",
)

# Months of a season, starting with December.
SEASONS_FROM_DECEMBER = ("Winter", "Spring", "Summer", "Autumn")

# First hour and first hour after, by daypart; all other hours are night.
DAYPART_HOURS = (("Morning", 5, 12), ("Afternoon", 12, 17), ("Evening", 17, 21))
NIGHT = "Night"

# Ordinal codes 1..4 are the positions in these tuples.
SEASON_ORDER = ("Spring", "Summer", "Autumn", "Winter")
DAYPART_ORDER = ("Morning", "Afternoon", "Evening", "Night")

# Option label by word in the name (first match wins), and its icon.
OPTION_WORDS = (("hot", "Hot Option"), ("cold", "Cold Option"))
OPTION_DEFAULT = "Warm Option"
OPTION_ICONS = {"Hot Option": "🌶️", "Cold Option": "🍦", "Warm Option": "🍜"}

# The value that switches a filter off.
ALL = "All"

# City centres, and the centre of every other city.
CITY_CENTERS = (("Warsaw", 52.2298, 21.0118), ("Krakow", 50.0647, 19.9450))
DEFAULT_CENTER = (52.2298, 21.0118)

# Candidate sites per ring and half width of each ring's box in degrees.
SITES_PER_RING = 17
RING_DEGREES = (0.01, 0.03, 0.06)

# Sampling, split and model settings.
OPTION_SAMPLE_FRACTION = 0.1
SALES_SAMPLE_SEED = 17
GEO_SAMPLE_SEED = 42
TRAIN_PERCENT = 80
MODEL_SEED = 17
MODEL_TREES = 100
FORECAST_DAYS = 365
TOP_N = 3

# Menu types with customer rating and picture.
MENUS = (
    ("Vegetarian", 4.0, "https://www.gigadocs.com/blog/wp-content/uploads/2020/03/istock-955998758.jpg"),
    ("Sandwiches", 4.5, "https://realfood.tesco.com/media/images/RFO-MAIN-472x310-ChickenClubSandwich-4ec15d7a-9867-4b62-831d-62dd9ad5c039-0-472x310.jpg"),
    ("Poutine", 4.0, "https://images.themodernproper.com/billowy-turkey/production/posts/2022/HomemadePoutineRecipe_Shot8_78.jpg?w=960&h=720&q=82&fm=jpg&fit=crop&dm=1667570349&s=5114ab356816ecbca4ab2eff55ac4b13"),
    ("BBQ", 5.0, "https://www.hartsfurniture.co.uk/media/mageplaza/blog/post/5/_/5._bbq.jpg"),
    ("Mac & Cheese", 4.5, "https://www.allrecipes.com/thmb/e8uotDI18ieXNBY0KpmtGKbxMRM=/1500x0/filters:no_upscale():max_bytes(150000):strip_icc()/238691-Simple-Macaroni-And-Cheese-mfs_008-4x3-6ed91ba87a1344558aacc0f9ef0f4b41.jpg"),
    ("Ramen", 4.5, "https://www.kikkoman.co.uk/fileadmin/user_upload/kikkoman.eu/Food-News/UK_What-is-Ramen/Blog_What-is-Ramen_Header_Desktop.jpg"),
    ("Crepes", 4.0, "https://foodcrumbles.com/wp-content/uploads/2015/12/Frech-crepes-freshly-made-with-fruits-735x490.jpg"),
    ("Hot Dogs", 4.0, "https://staticcookist.akamaized.net/wp-content/uploads/sites/22/2022/07/Hot-dogs-10.jpg"),
    ("Tacos", 4.5, "https://gypsyplate.com/wp-content/uploads/2022/07/birria-tacos_square.jpg"),
    ("Ethiopian", 3.5, "https://migrationology.com/wp-content/uploads/2014/02/ethiopian-food.jpg"),
    ("Indian", 4.0, "https://www.tastingtable.com/img/gallery/20-delicious-indian-dishes-you-have-to-try-at-least-once/intro-1645057933.jpg"),
    ("Gyros", 4.0, "https://www.allincrete.com/wp-content/uploads/2019/12/two-lamb-gyros-with-feta-cheese-tzatziki-sauce-allincrete.com_.jpg"),
    ("Grilled Cheese", 4.5, "https://grilledcheesesocial.com/wp-content/uploads/2024/04/marry-me-grilled-cheese-sandwich-12.jpg"),
    ("Ice Cream", 5.0, "https://www.chhs.colostate.edu/fsi/wp-content/uploads/sites/51/2024/07/ice-cream-cones-1-800x0-c-default.jpg"),
)
