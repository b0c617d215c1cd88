"""Fixed values of the grocery-circular domain.

Word lists, lookup tables, regular expressions and constants that decide results.  They are data, not
logic: every entry is stated as plain text in its natural order, because "first match wins" is part
of the meaning of most of these tables.  Regular expressions use the syntax shared by Java and Python.
"""

from __future__ import annotations

# ---- Fixed values: store-brand registries of the two banner families
STORE_BRANDS_ALBERTSONS = [
    "Signature SELECT", "Signature Farms", "Lucerne", "O Organics", "Open Nature", "Waterfront BISTRO",
    "Primo Taglio", "Value Corner", "Soleil", "ReadyMeals", "Signature Care", "Signature Cafe",
    "Debi Lilly Design",
]
STORE_BRANDS_AHOLD = [
    "Our Brand", "Giant", "Martin's", "Nature's Promise", "Taste of Inspirations", "Guiding Stars", "CareOne",
    "Smart Way", "Companion", "Guaranteed Value",
]
STORE_BRANDS = STORE_BRANDS_ALBERTSONS + STORE_BRANDS_AHOLD

# ---- Fixed values: default national-brand registry (callers may pass their own)
NATIONAL_BRANDS = [
    "McCormick", "Kraft", "Pillsbury", "Ro-Tel", "Libby's", "Bush's", "Mission", "Fage", "Horizon", "Daisy",
    "Philadelphia", "Lays", "Lay's", "Cheetos", "Ruffles", "Doritos", "Tostitos", "Smartfood", "Frito Lay",
    "Utz", "Planters", "Cheez-It", "Cheez It", "Goldfish", "Pringles", "Ritz", "Triscuit", "Wheat Thins",
    "Club", "Town House", "Coca-Cola", "Pepsi", "Gatorade", "Propel", "Budweiser", "Bud", "Canada Dry",
    "Schweppes", "Polar", "Shiner", "Corona", "Modelo", "Dos Equis", "Decoy", "Conundrum", "Kendall-Jackson",
    "Josh Cellars", "Josh", "La Crema", "Meiomi", "Kim Crawford", "Chateau Ste. Michelle", "Bogle",
    "Robert Mondavi", "Barefoot", "Woodbridge", "Sutter Home", "Yellow Tail", "Cupcake", "Stella Rosa",
    "14 Hands", "Headsnapper", "Andre", "Firefly Ridge", "Menage A Trois", "Ménage à Trois", "Chloe",
    "Nobilo", "Rold Gold", "Miss Vickie's", "Snapple", "Poppi", "Ozarka", "Sunny Delight", "Sparkling Ice",
    "Body Armor", "BodyArmor", "Dr. Pepper", "Dr Pepper", "Powerade", "Vitamin Water", "Dasani", "Snuggle",
    "Purex", "Premier Protein", "Tina's", "Yoplait", "Chobani", "Dannon", "Oikos", "Tillamook", "Turkey Hill",
    "Banquet", "BelGioioso", "Aleia's", "Sparkle", "Artesano", "Quaker", "Cap'n Crunch", "Life", "Campbell's",
    "Chef Boyardee", "Barilla", "Swanson", "College Inn", "Progresso", "Pacific Foods", "Knorr",
    "Kitchen Basics", "Imagine", "Lipton", "Dole", "Bolthouse", "Bolthouse Farms", "NatureSweet",
    "Fresh Express", "Taylor Farms", "Earthbound Farm", "Organic Girl", "Green Giant", "Birds Eye",
    "Driscoll's", "Sunkist", "Halo", "Cuties", "Chiquita", "Del Monte", "Stouffer's", "Lean Cuisine",
    "Perdue", "Tyson", "Oscar Mayer", "Hormel", "Eckrich", "Johnsonville", "Smithfield", "Farmland",
    "Aidells", "Hatfield", "Butterball", "Jennie-O", "Sugardale", "Jimmy Dean", "Hillshire Farm",
    "Hillshire Farms", "Applegate", "Hebrew National", "Ball Park", "Nathan's", "General Mills", "Kellogg's",
    "Post", "Sargento", "Cabot", "Hidden Valley", "Ken's", "Ken's Steak House", "Marzetti", "Newman's Own",
    "Wish-Bone", "Heinz", "French's", "Hellmann's", "Best Foods", "Duncan Hines", "Betty Crocker",
    "Ghirardelli", "Nestle Toll House", "Nestlé Toll House", "Toll House", "Carnation", "Baker's",
    "Hershey's", "Hershey", "Domino", "C&H", "Crisco", "Gold Medal", "King Arthur", "Jell-O", "Jello", "PAM",
    "Fleischmann's", "Arm & Hammer", "Morton", "Smucker's", "Jif", "Skippy", "Peter Pan", "Nutella",
    "Log Cabin", "Mrs. Butterworth's", "Pearl Milling Company", "Cape Cod", "Snyder's of Hanover",
    "Late July", "CLIF", "Clif Bar", "LUNA", "KIND", "Larabar", "Nature Valley", "RXBAR", "Think!", "Quest",
]

# ---- Fixed values: department banner titles that are not products
DEPARTMENT_BANNERS = [
    "meat", "meat & seafood", "produce", "deli", "bakery", "dairy", "frozen", "grocery", "groceries",
    "floral", "general merchandise", "beer & wine", "beer", "wine", "fresh produce", "fresh meat & seafood",
    "deli & bakery", "pharmacy", "freshpass", "personal care & health", "pet care", "household essentials",
    "from your full service butcher block", "full service butcher block", "butcher block",
    "service butcher block", "from our service butcher block", "from your butcher block",
    "from our butcher block", "full service meat counter", "service seafood counter", "from our bakery",
    "from our deli",
]

# ---- Fixed values: head-noun patterns, tried in this order
HEAD_NOUN_PATTERNS = [
    r"Greenhouse\s+Grown\s+(?:Salad\s+(?:Blends?|Kits?|Bowls?))",
    r"Salad\s+(?:Blends?|Kits?|Bowls?)(?:\s+or\s+(?:Salad\s+)?(?:Blends?|Kits?|Bowls?))?",
    r"(?:Baby\s+Bella\s+|White\s+|Portabella\s+|Button\s+)?Mushrooms?", r"(?:Chicken\s+)?Breasts?",
    r"Whole\s+Chickens?", r"Chicken\s+(?:Thighs|Drumsticks|Wings|Tenders|Cutlets)",
    r"Pork\s+Loin\s+Chops?|Pork\s+Loin|Pork\s+Chops?|Pork\s+(?:Butt|Shoulder)(?:\s+Roasts?)?|Pork\s+Tenderloins?|Pork\s+(?:Spare\s*)?Ribs?|Baby\s+Back\s+Ribs?|Catfish(?:\s+Nuggets?|\s+Fillets?)?",
    r"Cheese|Cheddar|Mozzarella|Swiss|Provolone|Parmesan\s+Cheese",
    r"Squash|Pumpkin(?:s)?|Potato(?:es)?|Apple(?:s)?|Grape(?:s)?|Pear(?:s)?|Melon(?:s)?",
    r"Pepper(?:s)?|Onion(?:s)?|Tomato(?:es)?|Orange(?:s)?|Citrus|Peach(?:es)?|Plum(?:s)?",
    r"(?:Straw|Blue|Rasp|Black)?berr(?:ies|y)|Parfaits?|Tortillas?|Pizza\s+Crusts?|Crusts?",
    r"Bread|Buns|Rolls|Butter|Yogurt|Milk|Eggs", r"Sugar|Flour|Frosting|Cakes?|Brownies?|Muffins?|Cookies?",
    r"Sausage\s+(?:Links|Patties|Rolls)|Sausage|Bacon", r"Dressing", r"(?:Potato\s+|Tortilla\s+)?Chips?",
    r"Pretzels?", r"Crackers?", r"Trays?|Platters?", r"Bars?", r"Beer", r"Soups?", r"Pastas?", r"Cereals?",
]

# ---- Fixed values: single words that count as a head noun
HEAD_NOUN_WORDS = [
    "pumpkins", "pumpkin", "squash", "potatoes", "potato", "apples", "apple", "grapes", "grape", "pears",
    "pear", "melons", "melon", "peppers", "pepper", "onions", "onion", "tomatoes", "tomato", "oranges",
    "orange", "citrus", "peaches", "peach", "plums", "plum", "berries", "berry", "strawberries", "strawberry",
    "blueberries", "blueberry", "raspberries", "raspberry", "blackberries", "blackberry", "cheese",
    "mushrooms", "parfait", "parfaits", "tortillas", "crust", "crusts", "bread", "buns", "rolls", "butter",
    "yogurt", "milk", "eggs", "bacon", "chicken", "breasts", "thighs", "drumsticks", "tenders", "cutlets",
    "wings", "chops", "roast", "roasts", "pork", "loin", "butt", "shoulder", "tenderloin", "catfish",
    "nuggets", "ribs", "sugar", "flour", "frosting", "cake", "cakes", "brownie", "brownies", "muffins",
    "muffin", "cookies", "cookie", "chips", "chip", "pretzels", "pretzel", "crackers", "cracker", "tray",
    "trays", "platter", "platters", "bars", "bar", "beer", "soda", "cereal", "soup", "pasta", "beans",
    "sauce", "broth", "dip", "salsa", "hummus", "pizza", "water", "tea", "coffee", "juice",
]

# ---- Fixed values: meat words
MEAT_KEYWORDS = [
    "chicken", "beef", "pork", "turkey", "roast", "steak", "steaks", "chop", "chops", "rib", "ribs", "thigh",
    "thighs", "breast", "breasts", "drumstick", "drumsticks", "wing", "wings", "tenderloin", "brisket",
    "sausage", "bacon", "loin",
]

# ---- Fixed values: seasoning packets
SEASONING_KEYWORDS = [
    "taco seasoning", "seasoning mix", "gravy mix", "fajita seasoning", "chili seasoning",
    "sloppy joe seasoning",
]

# ---- Fixed values: deli-counter brands
DELI_BRANDS = [
    "Primo Taglio", "Dietz & Watson", "Dietz Watson", "Boar's Head",
]

# ---- Fixed values: food words that rule out a brand pair
FOOD_KEYWORDS = [
    "bacon", "lunchmeat", "sausage", "chicken", "beef", "pork", "steak", "roast", "fillet", "fillets",
    "shrimp", "salmon", "cheese", "eggs", "milk", "butter", "bread",
]

# ---- Fixed values: titles that stand for no particular product
PLACEHOLDER_NAMES = [
    "assorted products", "assorted product", "assorted varieties", "select varieties", "selected varieties",
    "mix or match", "exclusive", "exclusive digital coupon", "exclusive digital coupon for u",
    "digital coupon", "store coupon", "pocket", "wrap", "egg bites", "lunch sandwich", "breakfast sandwich",
    "gas rewards", "we deliver!", "we deliver", "baby club savings", "baby club", "free flu shot",
    "free flu shot + up to $20 off groceries",
]

# ---- Fixed values: sales-note patterns, deleted one after another
SALES_NOTE_PATTERNS = [
    r",?\s*Sold in (?:a|the)?\s*\d+(?:\.\d+)?\s*(?:lb|oz|ct|bag|package|pkg|box|container)\.?\s*(?:bag|package|pkg|box|container)?(?:\s+for\s+\$\d+(?:\.\d+)?)?(?:\s*(?:each|ea)\b)?(?:\s*Limit\s*\d+)?\.?",
    r",?\s*Sold in (?:a|the) bag",
    r",?\s*Sold by the (?:ea|lb|each|pound)",
    r"\bLimit\s+\d+\b",
    r",?\s*(?:or\s+)?Seasoned(?:\s+\$?\d+(?:\.\d+)?)?(?:\s*(?:lb|each))?\.?",
    r",?\s*(?:Select|Selected)\s+Varieties\b",
    r",?\s*Grade\s+AA?\b",
    r",?\s*-\s*Each(?:\.{2,}.*|\s*\(.*?\))?",
    r"\s*\((?:traditionally\s+comes|approx|locally\s+grown)[^\)]*\)",
    r"\.{2,}.*$",
    r",?\s*(?:-\s*)?\bBUY\s+\d+\s*(?:[•\-\u00a0\s]|GET)\s*(?:GET\s+)?\d+\s+(?:OF\s+EQUAL\s+OR\s+LESSER\s+VALUE\s+)?FREE!?(?:\s+(?:of\s+)?equal(?:\s+or\s+lesser\s+value)?.*)?",
    r",?\s*(?:-\s*)?\bBUY\s+(?:ONE|TWO)\s+GET\s+(?:ONE|TWO)\s+FREE!?(?:\s+(?:of\s+)?equal(?:\s+or\s+lesser\s+value)?.*)?",
    r",?\s*(?:-\s*)?\bBOGO\s+FREE!?(?:\s+(?:of\s+)?equal(?:\s+or\s+lesser\s+value)?.*)?",
    r",?\s*\bBUY\s+\d+\s+GET\s+\d+\s+(?:\d+%\s*OFF|HALF\s+OFF|50%\s*OFF)\b",
    r",?\s*\b(?:MUST\s+BUY|WHEN\s+YOU\s+BUY)\s+\d+(?:\s+OR\s+MORE)?(?:\s*@\s*\$?\d+(?:\.\d{2})?)?(?:\s*(?:EA|EACH))?\b",
    r",?\s*\b(?:WITH\s+)?(?:DIGITAL\s+COUPON|FOR\s*U\s*COUPON|FOR\s*U|JUST\s*FOR\s*U|MEMBER\s+PRICE|WITH\s+CARD)(?:\s*\$?\d+(?:\.\d{2})?)?\b",
    r",?\s*\b(?:SAVE|\$)\s*\d+(?:\.\d{2})?\s+(?:OFF\s+)?(?:WITH\s+)?(?:DIGITAL\s+COUPON|FOR\s*U)\b",
    r",?\s*-\s*\$\d+(?:\.\d{2})?(?:\s*off)?(?:\s*/\s*(?:lb|ea|count|oz|pkg))?\.?\s*(?:DIGITAL\s+COUPON|FOR\s*U|WITH\s+CARD|MEMBER\s+PRICE)?.*$",
    r",?\s*-\s*(?:BONUS\s+BUY\s+SAVINGS\s+)?(?:\d+(?:\.\d{2})?\s*Off|\d+%\s*Off)(?:\s*/\s*(?:lb|ea|count|oz|pkg))?\.?.*$",
    r",?\s*-\s*\d+\s*(?:/|for)\s*\$?\d+(?:\.\d{2})?.*$",
    r",?\s*(?:-\s*)?\$?\d+(?:\.\d{2})?\s*/\s*(?:lb|ea|count|oz|pkg)\.?\s*(?:DIGITAL\s+COUPON|FOR\s*U|WITH\s+CARD|MEMBER\s+PRICE)\b",
    r",?\s*-\s*buy this\b.*?get (?:this|these) FREE\*?.*$",
    r",?\s*-\s*SAVE\s+\$?\d+.*$",
    r",?\s*(?:-\s*)?(?:\$\d+(?:\.\d{2})?\s*(?:/(?:ea|lb|count|oz|pkg)\.?)?\s*)?\bevery\s*day\b.*$",
    r"(?<!\d)\s+-\s+\d+(?:\.\d+)?\s*(?:ct|count|pk|pack)$",
    r",?\s*(?:-\s*)?(?:\d+[-\s]+POINT\s+FREEBIE|FREE\s+(?:.*?\s+)?when\s+you\s+redeem\s+\d+\s+(?:CHOICE\s+)?points?)(?:,?\s*Save\s+(?:at\s+least|up\s+to)?\s*\$?\d+(?:\.\d{2})?)?.*$",
    r",?\s*(?:-\s*)?Save\s+(?:at\s+least|up\s+to)?\s*\$?\d+(?:\.\d{2})?\s*(?:with\s+this\s+week['’]?s\s+meal\s+deal)?.*$",
]

# ---- Fixed values: fragments that are not products
DISCARD_FRAGMENT = (
    r"^(Sold in|Sold by|Limit \d+|Seasoned \$|\$\d+|for \$|each Limit|Select Varieties|Selected Varieties|\d+[-\s]+POINT\s+FREEBIE|Save at least|Save up to)"
)

# ---- Fixed values: commodity categories, first match wins
COMMODITY_RULES = [
    (r"\bcream\s+cheese\b", "Cream Cheese"),
    (r"\bshredded\s+cheese\b", "Shredded Cheese"),
    (r"\bsliced\s+cheese\b", "Sliced Cheese"),
    (r"\b(?:chunk|block)\s+cheese\b", "Chunk Cheese"),
    (r"\bstring\s+cheese\b", "String Cheese"),
    (r"\bcheese\b", "Cheese"),
    (r"\b(?:egg\s+)?noodles?\b", "Pasta"),
    (r"\begg\s*rolls?\b", "Deli"),
    (r"\beggs?\b", "Eggs"),
    (r"\b(?:ice\s+cream|frozen\s+dairy\s+dessert|gelato|sorbet)\b", "Ice Cream"),
    (r"(?<!peanut\s)(?<!apple\s)(?<!cookie\s)(?<!cocoa\s)(?<!body\s)\bbutter\b", "Butter"),
    (r"\bmilk\b", "Milk"),
    (r"\byogurt\b", "Yogurt"),
    (r"\bsour\s+cream\b", "Sour Cream"),
    (r"\b(?:deli\s+(?:sliced|premium|homestyle)?|lunchmeat|dietz\s*&\s*watson)\b", "Deli"),
    (r"\bbacon\b", "Bacon"),
    (r"\bsausage\b", "Sausage"),
    (r"\bhot\s*dogs?\b", "Hot Dogs"),
    (r"\bturkey\b(?!\s+hill\b)", "Turkey"),
    (r"\b(?:beef|filet\s+mignon)\b.*\btenderloins?\b|\btenderloins?\b.*\b(?:beef|filet\s+mignon)\b|\bfilet\s+mignon\b|\bbeef\s+tenderloin\b", "Beef"),
    (r"\bpork\b.*\btenderloins?\b|\bpork\s+tenderloin\b", "Pork Chops"),
    (r"\bboneless\b.*\b(?:chicken\s+)?breasts?\b|\b(?:chicken\s+)?breasts?\b.*\bboneless\b", "Boneless Chicken Breasts"),
    (r"\b(?:split|bone-?in)\b.*\b(?:chicken\s+)?breasts?\b|\b(?:chicken\s+)?breasts?\b.*\b(?:split|bone-?in)\b", "Bone-In Chicken Breasts"),
    (r"\b(?:chicken\s+)?breasts?\b", "Boneless Chicken Breasts"),
    (r"\b(?:chicken\s+)?(?:tenders?|tenderloins?)\b", "Chicken Tenders"),
    (r"\bboneless\b.*\b(?:chicken\s+)?thighs?\b|\b(?:chicken\s+)?thighs?\b.*\bboneless\b", "Boneless Chicken Thighs"),
    (r"\b(?:bone-?in\b.*)?(?:chicken\s+)?thighs?\b|\bthighs?\b", "Bone-In Chicken Thighs"),
    (r"\bchicken\s+wings?\b", "Chicken Wings"),
    (r"\bchicken\s+drumsticks?\b", "Chicken Drumsticks"),
    (r"\bwhole\s+chickens?\b", "Whole Chicken"),
    (r"\bchicken\b", "Chicken"),
    (r"\bground\s+beef\b", "Ground Beef"),
    (r"\b(?:pork\s+)?(?:loin\s+)?chops?\b|\bpork\b.*\bchops?\b", "Pork Chops"),
    (r"\b(?:beef\s+)?short\s*ribs?\b|\bbeef\b.*\bribs?\b|\bribs?\b.*\bbeef\b", "Beef"),
    (r"\b(?:pork\s+)?(?:spare\s*ribs?|baby\s*back\s*ribs?|country\s*style\s*ribs?|st\.?\s*louis\s*(?:style\s*)?ribs?)\b|\bpork\b.*\bribs?\b", "Ribs"),
    (r"\bribs?\b", "Ribs"),
    (r"\bsteaks?\b", "Steak"),
    (r"\b(?:bottom|top|eye\s+of)\s+round\b|\bchuck(?:\s+shoulder)?\s+roast\b|\bshoulder\s+roast\b|\brump\s+roast\b|\bpork\s+butt\b|\bpork\s+loin\b|\bhalf\s+pork\s+loin\b|\broasts?\b", "Roast"),
    (r"\bbeef\b", "Beef"),
    (r"\bsalmon\b", "Salmon"),
    (r"\bshrimp\b", "Shrimp"),
    (r"\bpotato(?:es)?\b", "Potatoes"),
    (r"\bapples?\b", "Apples"),
    (r"\bpears?\b", "Pears"),
    (r"\bgrapes?\b", "Grapes"),
    (r"\b(?:soda|coca-cola|pepsi|dr pepper)\b", "Soda"),
    (r"\bpeanuts\b", "Nuts & Seeds"),
    (r"\bavocados?\b", "Avocados"),
    (r"\btomato(?:es)?\b", "Tomatoes"),
    (r"\bstrawberr(?:y|ies)\b", "Strawberries"),
    (r"\bblueberr(?:y|ies)\b", "Blueberries"),
    (r"\bsquash\b", "Squash"),
    (r"\bonions?\b", "Onions"),
    (r"(?<!dr\s)\bpeppers?\b", "Peppers"),
    (r"\bsalad\s+(?:blend|kit|bowl|greens)s?\b|\bsalads?\b|\bgreenhouse\s+grown\b", "Salad"),
    (r"\b(?:salad\s+)?dressings?\b", "Salad Dressing"),
    (r"\bbread\b", "Bread"),
    (r"\btortillas?\b", "Tortillas"),
    (r"\bpasta\s+sauce\b", "Pasta Sauce"),
    (r"\bpasta\b", "Pasta"),
    (r"\bcoffee\b", "Coffee"),
    (r"\bchips\b", "Chips"),
    (r"\bcrackers?\b|\bcheez-?it\b|\bgoldfish\b|\btriscuit\b|\bwheat\s+thins?\b|\britz\b", "Crackers"),
    (r"\bpopcorn\b", "Popcorn"),
    (r"\bsalsa\b", "Salsa"),
    (r"\bpizzas?\b", "Pizza"),
    (r"\bsoups?\b", "Soup"),
    (r"\bbroth\b", "Broth"),
    (r"\b(?:water|drinking water|spring water)\b", "Water"),
    (r"\b(?:gatorade|propel|powerade|sports drink)\b", "Sports Drinks"),
    (r"\b(?:chewing\s+|bubble\s+|sugar\s*free\s+)?gum\b(?!\s*(?:care|drop|bearing|tree|arabic|plant|assortment))\b|\b(?:trident|dentyne|hubba\s*bubba|dubble\s*bubble|juicy\s*fruit|doublemint)\b|\b(?:extra|orbit|eclipse|mentos|ice\s*breakers)\s+gum\b", "Gum"),
    (r"\b(?:wine|chardonnay|cabernet(?:\s+sauvignon)?|pinot\s+(?:noir|grigio)|merlot|sauvignon\s+blanc|moscato|rosé|rose\s+wine|prosecco|champagne|sparkling\s+wine|zinfandel|malbec|shiraz|syrah|riesling|red\s+blend|white\s+blend|bogle|menage\s+a\s+trois|m[eé]nage\s+[aà]\s+trois|chloe|nobilo|meiomi|la\s+crema|barefoot|woodbridge|sutter\s+home|yellow\s+tail|cupcake\s+wine|cupcake\s+vineyards|stella\s+rosa|14\s+hands|headsnapper|firefly\s+ridge|josh\s+cellars|lamarca|kim\s+crawford|freixenet|mionetto|unshackled|ghost\s+pines|freakshow|erath|decoy|conundrum|apothic|daou|caymus|kendall-jackson|robert\s+mondavi)\b", "Wine"),
    (r"\b(?:beer|ale|lager|ipa|stout|pilsner|hard\s+seltzer|cider|budweiser|bud\s+light|bud\s+miller|bud\s+coors|miller\s+lite|coors\s+light|michelob(?:\s+ultra)?|shiner|corona|modelo|dos\s+equis|pacifico|heineken|yuengling|white\s+claw|truly|twisted\s+tea|angry\s+orchard|topo\s+chico\s+hard|malt\s+beverage|hard\s+tea)\b", "Beer"),
]

# ---- Fixed values: department keywords, first match wins
DEPARTMENT_KEYWORDS = [
    ("wine", "Wine & Spirits"),
    ("beer", "Wine & Spirits"),
    ("liquor", "Wine & Spirits"),
    ("alcohol", "Wine & Spirits"),
    ("bakery", "Bakery"),
    ("bread", "Bakery"),
    ("donut", "Bakery"),
    ("produce", "Produce"),
    ("fruit", "Produce"),
    ("vegetable", "Produce"),
    ("dairy", "Dairy"),
    ("milk", "Dairy"),
    ("cheese", "Dairy"),
    ("yogurt", "Dairy"),
    ("meat", "Meat & Seafood"),
    ("seafood", "Meat & Seafood"),
    ("beef", "Meat & Seafood"),
    ("chicken", "Meat & Seafood"),
    ("pork", "Meat & Seafood"),
    ("deli", "Deli"),
    ("prepared", "Deli"),
    ("soup", "Deli"),
    ("frozen", "Frozen"),
    ("cereal", "Cereal & Breakfast"),
    ("breakfast", "Cereal & Breakfast"),
    ("beverage", "Beverages"),
    ("drink", "Beverages"),
    ("soda", "Beverages"),
    ("juice", "Beverages"),
    ("coffee", "Beverages"),
    ("snack", "Snacks & Candy"),
    ("chips", "Snacks & Candy"),
    ("chip", "Snacks & Candy"),
    ("candy", "Snacks & Candy"),
    ("gum", "Snacks & Candy"),
    ("canned", "Canned Goods"),
    ("pantry", "Pantry"),
    ("pasta", "Pantry"),
    ("sauce", "Pantry"),
    ("condiment", "Pantry"),
    ("personal care", "Personal Care"),
    ("beauty", "Personal Care"),
    ("health", "Health"),
    ("household", "Household"),
    ("clean", "Household"),
    ("baby", "Baby"),
    ("pet", "Pet Care"),
    ("general", "General Merchandise"),
    ("kitchen", "General Merchandise"),
    ("outdoor", "General Merchandise"),
    ("skewer", "General Merchandise"),
]

# ---- Fixed values: wine brands
WINE_BRANDS = [
    "lamarca", "kim crawford", "freixenet", "mionetto", "josh cellars", "josh", "headsnapper", "unshackled",
    "ghost pines", "freakshow", "erath", "decoy", "conundrum", "kendall-jackson", "chateau ste michelle",
    "chateau ste. michelle", "robert mondavi", "barefoot", "woodbridge", "sutter home", "yellow tail",
    "stella rosa", "14 hands", "andre", "firefly ridge", "menage a trois", "ménage à trois", "chloe",
    "nobilo", "meiomi", "la crema", "bogle", "apothic", "daou", "caymus",
]

# ---- Fixed values: beer and seltzer brands
BEER_SELTZER_BRANDS = [
    "bud", "budweiser", "bud light", "miller", "miller lite", "coors", "coors light", "michelob",
    "michelob ultra", "shiner", "corona", "modelo", "dos equis", "pacifico", "heineken", "yuengling",
    "samuel adams", "sam adams", "blue moon", "stella artois", "white claw", "truly", "twisted tea",
    "angry orchard", "topo chico hard",
]

# ---- Fixed values: alcohol words
ALCOHOL_WORDS = (
    r"\b(?:wine|chardonnay|cabernet(?:\s+sauvignon)?|pinot\s+(?:noir|grigio)|merlot|sauvignon\s+blanc|"
    r"moscato|prosecco|champagne|sparkling\s+wine|zinfandel|malbec|shiraz|syrah|riesling|"
    r"red\s+blend|white\s+blend|rosé|rose\s+wine|cupcake\s+wine|cupcake\s+vineyards|beer|lager|ipa|pilsner|stout|hard\s+seltzer|cider|"
    r"malt\s+beverage|hard\s+tea|vodka|whiskey|whisky|bourbon|rum|tequila|gin|cognac|liqueur)\b"
)

# ---- Fixed values: not alcohol words
NOT_ALCOHOL_WORDS = (
    r"\b(?:vinegar|ginger\s+ale|bouquet|sauce|glaze|marinade|non-alcoholic|dealcoholized|cake|cupcake|donut|bakery|bread|floral)\b"
)

# ---- Fixed values: commodity to shopper-facing department
COMMODITY_TO_DEPARTMENT = [
    ("Apples", "Produce"),
    ("Avocados", "Produce"),
    ("Bananas", "Produce"),
    ("Blueberries", "Produce"),
    ("Grapes", "Produce"),
    ("Onions", "Produce"),
    ("Pears", "Produce"),
    ("Peppers", "Produce"),
    ("Potatoes", "Produce"),
    ("Salad", "Produce"),
    ("Squash", "Produce"),
    ("Strawberries", "Produce"),
    ("Tomatoes", "Produce"),
    ("Beef", "Meat & Seafood"),
    ("Boneless Chicken Breasts", "Meat & Seafood"),
    ("Bone-In Chicken Breasts", "Meat & Seafood"),
    ("Chicken Tenders", "Meat & Seafood"),
    ("Boneless Chicken Thighs", "Meat & Seafood"),
    ("Bone-In Chicken Thighs", "Meat & Seafood"),
    ("Chicken Wings", "Meat & Seafood"),
    ("Chicken Drumsticks", "Meat & Seafood"),
    ("Whole Chicken", "Meat & Seafood"),
    ("Chicken", "Meat & Seafood"),
    ("Ground Beef", "Meat & Seafood"),
    ("Pork Chops", "Meat & Seafood"),
    ("Ribs", "Meat & Seafood"),
    ("Steak", "Meat & Seafood"),
    ("Roast", "Meat & Seafood"),
    ("Salmon", "Meat & Seafood"),
    ("Shrimp", "Meat & Seafood"),
    ("Turkey", "Meat & Seafood"),
    ("Bacon", "Meat & Seafood"),
    ("Sausage", "Meat & Seafood"),
    ("Hot Dogs", "Meat & Seafood"),
    ("Butter", "Dairy & Eggs"),
    ("Cheese", "Dairy & Eggs"),
    ("Cream Cheese", "Dairy & Eggs"),
    ("Shredded Cheese", "Dairy & Eggs"),
    ("Sliced Cheese", "Dairy & Eggs"),
    ("Chunk Cheese", "Dairy & Eggs"),
    ("String Cheese", "Dairy & Eggs"),
    ("Eggs", "Dairy & Eggs"),
    ("Milk", "Dairy & Eggs"),
    ("Sour Cream", "Dairy & Eggs"),
    ("Yogurt", "Dairy & Eggs"),
    ("Bread", "Bakery & Bread"),
    ("Tortillas", "Bakery & Bread"),
    ("Ice Cream", "Frozen Foods"),
    ("Pizza", "Frozen Foods"),
    ("Pasta", "Pantry & Dry Goods"),
    ("Pasta Sauce", "Pantry & Dry Goods"),
    ("Soup", "Pantry & Dry Goods"),
    ("Broth", "Pantry & Dry Goods"),
    ("Salad Dressing", "Pantry & Dry Goods"),
    ("Salsa", "Pantry & Dry Goods"),
    ("Chips", "Snacks & Candy"),
    ("Crackers", "Snacks & Candy"),
    ("Popcorn", "Snacks & Candy"),
    ("Nuts & Seeds", "Snacks & Candy"),
    ("Gum", "Snacks & Candy"),
    ("Coffee", "Beverages"),
    ("Soda", "Beverages"),
    ("Water", "Beverages"),
    ("Sports Drinks", "Beverages"),
    ("Beer", "Beer, Wine & Spirits"),
    ("Wine", "Beer, Wine & Spirits"),
    ("Deli", "Deli & Prepared"),
]

# ---- Fixed values: shopper-facing department by text, first match wins
DEPARTMENT_TEXT_RULES = [
    (r"\b(?:wine|chardonnay|cabernet|pinot|merlot|sauvignon|moscato|prosecco|champagne|beer|ale|lager|ipa|pilsner|stout|hard\s+seltzer|cider|budweiser|bud\s+light|miller\s+lite|coors\s+light|michelob|corona|modelo|heineken|white\s+claw|truly|twisted\s+tea)\b", "Beer, Wine & Spirits"),
    (r"\b(?:beef|chicken|pork|turkey|steak|bacon|sausage|frank|hot\s*dog|meatball|ham\b|roast\b|ribeye|sirloin|tenderloin|salmon|shrimp|tilapia|cod\b|crab|lobster|tuna|scallop|fillet|seafood|poultry|scrapple|prosciutto|salami|pepperoni|meat\s+stick)\b", "Meat & Seafood"),
    (r"\b(?:apple|apples|banana|bananas|berry|berries|grape|grapes|citrus|orange|oranges|lemon|lemons|lime|limes|potato|potatoes|onion|onions|pepper|peppers|tomato|tomatoes|salad|lettuce|spinach|carrot|carrots|broccoli|celery|avocado|avocados|mushroom|mushrooms|cucumber|cucumbers|squash|floral|bouquet|rose|roses|plant|fresh\s+cut|asparagus|corn\b|herbs?|garlic|cantaloupe|watermelon|honeydew|pineapple|mango|clementine|peach|peaches|plum|cabbage|kale|zucchini)\b", "Produce"),
    (r"\b(?:milk|cheese|butter|yogurt|cream\s+cheese|sour\s+cream|cottage\s+cheese|half\s*&\s*half|creamer|egg|eggs|parmesan|cheddar|mozzarella|ricotta|provolone|brie|gouda|feta|swiss\s+cheese)\b", "Dairy & Eggs"),
    (r"\b(?:frozen|ice\s+cream|gelato|sorbet|pizza|waffle|waffles|popsicles?|hot\s+pockets?|frozen\s+dinner|entrees?|frozen\s+fruit|frozen\s+vegetable|ice\b|totino|birds\s+eye|green\s+giant\s+steam|stouffer|lean\s+cuisine|marie\s+callender|digiorno)\b", "Frozen Foods"),
    (r"\b(?:bread|bagel|bagels|muffin|muffins|roll|rolls|buns?|tortilla|tortillas|croissant|donut|doughnut|cake|cakes|pie\b|pies\b|pastry|pastries|bakery|danish|cupcake|cupcakes)\b", "Bakery & Bread"),
    (r"\b(?:coffee|tea\b|juice|soda|water|sparkling\s+water|seltzer|cola|pepsi|coke\b|dr\s+pepper|snapple|lemonade|drink|drinks|gatorade|powerade|beverage|k-cup|cider|kombucha|shake\b|smoothie|bolthouse)\b", "Beverages"),
    (r"\b(?:chips|crisps|crackers|cookies?|popcorn|pretzel|pretzels|snack|snacks|candy|chocolate|chocolates|gummy|gummies|fudge|nuts|cashews|almonds|peanuts|granola\s*bars?|protein\s*bars?|chewy\s*bars?|bars?\b|fruit\s+snacks?|trail\s+mix|cheez-it|oreo|doritos|lays|tostitos|snack\s+mix|goldfish)\b", "Snacks & Candy"),
    (r"\b(?:cereal|oatmeal|pasta|macaroni|sauce|marinara|soup|soups|broth|canned|beans|rice|oil|olive\s+oil|flour|sugar|spice|spices|seasoning|mayonnaise|mustard|ketchup|dressing|condiment|condiments|syrup|peanut\s+butter|jelly|jam|pantry|baking|mix\b|mashed\s+potatoes|tuna\s+can|gravy|stuffing|mccormick|oregano|thyme|chili\s+powder|cumin|coriander|cinnamon|paprika|curry\b|garam\s+masala|tarragon|dill\s+weed|vanilla\s+extract|baking\s+soda|yeast|vinegar|honey)\b", "Pantry & Dry Goods"),
    (r"\b(?:detergent|laundry|bleach|towel|paper\s+towels?|bath\s+tissue|toilet\s+paper|napkin|napkins|cleaner|disinfect|trash\s+bag|trash\s+bags|foil|wrap|ziploc|dish\s+soap|dishwasher|air\s+freshener|dryer\s+sheet|dryer\s+sheets|gain|tide|bounce|bounty|charmin|skewers?|toothpick|toothpicks|thermometer|scent\s+booster|downy|dreft|fabric\s+softener|swiffer|clorox|lysol|glade|febreze|dawn|finish|cascade|storage\s+bags?|aluminum\s+foil|candles?|batter(?:y|ies)|bag\s+clips?|clips?|cups?|plates?|bowls?|straws?|food\s+storage)\b", "Household & Cleaning"),
    (r"\b(?:shampoo|conditioner|body\s+wash|soap|deodorant|toothpaste|toothbrush|lotion|skincare|cosmetic|vitamin|vitamins|supplement|supplements|medicine|cold|flu|pain\s+relief|band-aid|care|pads?|tampons?|liners?|floss|dental|oral-b|colgate|crest|dove|pantene|head\s+&\s+shoulders|tampax|always|razor|razors|shave|antiperspirant)\b", "Health & Beauty"),
    (r"\b(?:diaper|diapers|wipes|baby|baby\s+food|formula|pampers|huggies|gerber|goodnites|pull-ups?|aquaphor|aveeno|dog\s+food|cat\s+food|pet|pets|cat\s+litter|kibble|puppy|kitten|purina|pedigree|friskies|fancy\s+feast|blue\s+buffalo)\b", "Baby & Pet"),
    (r"\b(?:deli|prepared|rotisserie|hummus|dips?|guacamole|sushi|sandwich|salad\s+bar|ready\s+to\s+eat|take\s*&\s*bake)\b", "Deli & Prepared"),
]

# ---- Fixed values: loyalty programmes (program, point name, dollars per point, reward label)
LOYALTY_CHOICE = ("Giant Choice", "CHOICE points", 0.0274, "grocery rewards")
LOYALTY_FOR_U = ("for U", "for U points", 0.0150, "for U rewards")
FOR_U_TEXT = ["for u", "foru"]
CHOICE_TEXT = ["choice", "point freebie", "point-freebie"]
CHOICE_MERCHANTS = ["giant"]
FOR_U_MERCHANTS = ["tomthumb", "safeway", "albertsons", "vons", "jewelosco", "acme", "shaw"]

# ---- Fixed values: promotion wording
NUMBER_WORDS = [("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5), ("six", 6)]
BOGO_FREE = (
    r"\bBUY\s+(\d+|ONE|TWO|THREE|FOUR|FIVE|SIX)\s+GET\s+(\d+|ONE|TWO|THREE|FOUR|FIVE|SIX)\s+"
    r"(?:OF\s+EQUAL\s+OR\s+LESSER\s+VALUE\s+)?(?:MUST\s+BUY\s+LIKE\s+BRAND\s+)?FREE\b"
)
BOGO_PERCENT = (
    r"\bBUY\s+(\d+|ONE|TWO|THREE|FOUR)\s+GET\s+(\d+|ONE|TWO|THREE|FOUR)\s+(?:AT\s+)?"
    r"(?:(\d+)%\s*OFF|HALF\s+OFF|50%\s*OFF)\b"
)
BOGO_GENERIC = r"\b(?:BOGO\s+FREE|BUY\s+ONE\s+GET\s+ONE\s+FREE)\b"
MUST_BUY_AT_PRICE = (
    r"\b(?:MUST\s+BUY|WHEN\s+YOU\s+BUY|BUY)\s+(\d+)(?:\s+OR\s+MORE)?(?:.*?)(?:@|\$)\s*(\d+(?:\.\d{2})?)"
    r"(?:\s*(?:EA|EACH))?\b"
)
MUST_BUY_QTY = r"\b(?:MUST\s+BUY|WHEN\s+YOU\s+BUY)\s+(\d+)\b"
X_FOR_Y = r"\b(\d+)\s*(?:FOR\s+\$?|/\s*\$)\s*(\d+(?:\.\d{2})?)\b"
BUNDLE_PREFIX = r"^\s*(\d+)\s*(?:/|for)\s*$"
COUPON_FINAL_PRICE = (
    r"(?:\b(?:WITH\s+)?(?:DIGITAL\s+COUPON|FOR\s*U\s*COUPON|FOR\s*U|JUST\s*FOR\s*U|MEMBER\s+PRICE|WITH\s+CARD)"
    r".*?\$(\d+(?:\.\d{2})?)\b(?!\s*OFF)|\$(\d+(?:\.\d{2})?)(?:\s*/\s*(?:lb|ea|count|oz|pkg))?\.?\s*"
    r"(?:DIGITAL\s+COUPON|FOR\s*U\s*COUPON|FOR\s*U|JUST\s*FOR\s*U|MEMBER\s+PRICE|WITH\s+CARD)\b)"
)
COUPON_DISCOUNT = r"\b(?:SAVE\s+)?\$?(\d+(?:\.\d{2})?)\s*(?:OFF)?\s*(?:WITH\s+)?(?:DIGITAL\s+COUPON|FOR\s*U)\b"
REDEEM_POINTS = r"(?:(?:REDEEM|WITH)\s+(\d+)\s+(?:CHOICE\s+|FOR\s*U\s+)?POINTS|(\d+)[-\s]+POINT\s+FREEBIE)"
SAVE_AMOUNT = r"SAVE\s+(?:UP\s+TO\s+|AT\s+LEAST\s+)?\$(\d+(?:\.\d{2})?)"
FREE_WITH_BUY = r"\bFREE\b.*?\b(?:WHEN\s+YOU\s+BUY|WITH\s+(?:PURCHASE\s+OF)?)\s+(\d+)\b"
POINTS_FOR_SPEND = r"(\d+)\s+(?:CHOICE\s+|FOR\s*U\s+)?POINTS\s+WHEN\s+YOU\s+SPEND\s+\$(\d+(?:\.\d{2})?)"
POINTS_FOR_BUY = r"(\d+)\s+(?:CHOICE\s+|FOR\s*U\s+)?POINTS\s+WHEN\s+YOU\s+BUY\s+(\d+)"
POINTS_MULTIPLIER = r"(?:EARN\s+)?(\d+)X\s+(?:CHOICE\s+|FOR\s*U\s+)?POINTS(?:\s+(?:WITH|FOR)\s+FOR\s*U)?"
SPEND_SAVE = (
    r"(?:SAVE\s+\$(\d+(?:\.\d{2})?)\s+(?:WHEN\s+YOU\s+SPEND|ON|OR)\s+\$(\d+(?:\.\d{2})?)|"
    r"\$(\d+(?:\.\d{2})?)\s*OFF\s*(?:ON|OR|WHEN\s+YOU\s+SPEND|OF)?\s*\$(\d+(?:\.\d{2})?))"
)
BUY_SAVE = r"SAVE\s+\$(\d+(?:\.\d{2})?)\s+WHEN\s+YOU\s+BUY\s+(\d+)"
PERCENT_OFF = r"\b(\d+)%\s*OFF\b"
DOLLAR_OFF = (
    r"\b(?:SAVE\s+(?:UP\s+TO\s+)?|.*?\$|\b)(\d+(?:\.\d{2})?)\s*OFF"
    r"(?:\s*(?:\/|\bper\b)\s*(lb|pound|ea|each|pkg|oz))?\.?\b"
)
CENTS_OFF = r"\b(\d+)\s*¢\s*OFF(?:\s*(?:\/|\bper\b)\s*(lb|pound|ea|each|pkg|oz))?\.?\b"
MEAL_DEAL_MAIN = r"BUY\s+THIS\s+(.*?)\s+GET\s+THESE\s+FREE"
MEAL_DEAL_NOISE = r"\b(?:Butcher Shop|U\.?S\.?D\.?A\.?|Choice|Fresh|Vacuum Sealed)\b.*"
HOLIDAY_BIRD = r"\b(?:turkey|tofurky)\b"
HOLIDAY_POINTS, HOLIDAY_SAVING, HOLIDAY_WINDOW = 400, 26.00, "Nov 6–26"

# ---- Fixed values: units of measure
UNIT_WORDS = r"(oz|ounce|lb|pound|ct|count|pk|pack|ltr|liter|quart|qt|pint|pt|gal|gallon|ml)"
NUM = r"(?:\d+(?:\.\d+)?|\.\d+)"
UNIT_PATTERN = rf"({NUM})\s*-\s*({NUM})\s*{UNIT_WORDS}\b|({NUM})\s*{UNIT_WORDS}\b"
COUNT_PER_POUND = r"\b(?:\d+\s*-\s*\d+|\d+)\s*(?:ct|count)\s*(?:per\s+(?:lb|pound)|/\s*(?:lb|pound))\b"
PER_UNIT_RATE = r"(?:per\s+|/\s*)(lb|pound|oz|ounce|ea|each|count|ct)\b"
UNIT_SYNONYMS = [
    ("ounce", "oz"), ("pound", "lb"), ("count", "ct"), ("pack", "pk"),
    ("liter", "ltr"), ("quart", "qt"), ("pint", "pt"), ("gallon", "gal"),
]
UNIT_SPELLINGS = [
    (r"(?:ct\.?|counts?)", "ct"), (r"(?:oz\.?|ounces?)", "oz"), (r"(?:lbs?\.?|pounds?)", "lb"),
    (r"(?:gal\.?|gallons?)", "gal"), (r"(?:ltr\.?|liters?)", "ltr"), (r"(?:qt\.?|quarts?)", "qt"),
    (r"(?:pt\.?|pints?)", "pt"),
]

# ---- Fixed values: shelf-price search terms
SEARCH_SIZE_TAIL = r"\b\d+(\.\d+)?\s*(oz|lb|ct|pk|count|fl\s*oz|ounce|pound|liter|l|ml|gal)\b.*"
SEARCH_PUNCTUATION = r"[,\(\)\-\:\®\™\.\*\'\"&]"
SEARCH_STOPWORDS = r"\b(or|and|of|for|with|in)\b"
SEARCH_FILLER = ["select", "varieties", "flavor", "flavors", "variety", "assorted", "fresh", "made"]

# ---- Fixed values: store presets (alias, zip, merchant, label) and defaults
STORE_PRESETS = [
    ("giant", "17837", "Giant Food Stores", "Giant (Lewisburg, PA 17837)"),
    ("lewisburg", "17837", "Giant Food Stores", "Giant (Lewisburg, PA 17837)"),
    ("giant_lewisburg", "17837", "Giant Food Stores", "Giant (Lewisburg, PA 17837)"),
    ("tomthumb", "75080", "Tom Thumb", "Tom Thumb (Richardson, TX 75080)"),
    ("tom_thumb", "75080", "Tom Thumb", "Tom Thumb (Richardson, TX 75080)"),
]
DEFAULT_STORE = "tomthumb"
DEFAULT_MERCHANT = "Tom Thumb"
DEFAULT_FRESHNESS_MERCHANT = "Giant Food Stores"
SOURCE_API, SOURCE_GRID, SOURCE_PREPARED = "flipp_api", "giant_grid_api", "video_ocr_untrusted"

# ---- Fixed values: badges
BADGE_RANK = [
    ("POINTS_FREEBIE", 0.0), ("NEW_ALL_TIME_LOW", 1.0), ("MATCHES_ATL", 1.1), ("ALL_TIME_LOW", 1.2),
    ("POINTS_DEAL", 2.0), ("POINTS_REWARD", 3.0), ("SPEND_SAVE", 4.0), ("PERCENT_OFF", 5.0),
    ("BEAT_AVERAGE", 6.0), ("CYCLE_REFRESH", 7.0), ("FIRST_SEEN", 8.0), ("POINTS_REDEMPTION", 9.0),
    ("STANDARD_DEAL", 10.0), ("PRICE_HIKE", 11.0), ("SEE_AD", 12.0),
]
ATL_BADGES = ["ALL_TIME_LOW", "NEW_ALL_TIME_LOW", "MATCHES_ATL"]
OUTLIER_PROMOS = ["doorbuster", "outlier"]

# ---- Fixed values: front-page detection and page defaults
THEMATIC_WORDS = [
    "halloween", "trick or treat", "trick-or-treat", "candy bag", "snack size bag", "candy bar",
    "marshmallow pumpkin", "fall truffle", "costume", "novelty", "cupcake", "halloween cakes",
    "rose bouquet", "party",
]
FRESH_ANCHOR_WORDS = [
    "chicken", "beef", "steak", "roast", "pork", "chop", "ribs", "shrimp", "salmon", "ground beef",
    "bacon", "turkey", "sirloin", "brisket", "fillet", "catfish", "lobster", "t-bone", "apple",
    "berries", "strawberry", "grape", "avocado", "broccoli", "lettuce", "banana", "citrus", "orange",
    "salad kit", "fresh express", "potato", "potatoes", "soup", "yogurt", "cereal",
]
DEPARTMENT_PAGES = [
    ("Produce", 12), ("Meat & Seafood", 4), ("Deli", 17), ("Bakery", 2), ("Dairy", 13), ("Frozen", 14),
    ("Pantry", 15), ("Beverages", 11), ("Snacks & Candy", 15), ("Canned Goods", 15), ("Personal Care", 19),
    ("Health", 19), ("Household", 20), ("Pet Care", 19), ("Baby", 23), ("General Merchandise", 22),
]
DEFAULT_PAGE = 15

# ---- Fixed values: history group keys
HISTORY_PLACEHOLDERS = [
    "assorted products", "assorted product", "assorted varieties", "select varieties",
    "selected varieties", "mix or match",
]

# ---- Fixed values: ad-group splitting and titles
BUNDLE_PROMOS = ["bogo", "bxgy", "buy_x_get_y", "must_buy", "bundle", "meal_deal", "mix_and_match"]
BUNDLE_WORDS = [
    "bogo", "buy 1 get", "buy 2 get", "buy 3 get", "buy one get", "get 1 free", "get 2 free", "get 3 free",
    "get one free", "when you buy", "must buy", "mix & match", "mix and match", "mix or match",
    "participating", "meal deal",
]
COMMODITY_CLUSTERS = [
    ["chicken", "pork", "beef", "turkey", "lamb", "salmon", "tilapia", "shrimp", "cod", "tuna", "seafood"],
    ["roast", "steak", "rib", "ribs", "chop", "chops", "cutlet", "breast", "breasts", "wings", "tenders",
     "ground", "loin", "sirloin"],
    ["apple", "apples", "orange", "oranges", "pomegranate", "pomegranates", "banana", "bananas", "berry",
     "berries", "grape", "grapes", "potato", "potatoes", "onion", "onions", "avocado", "avocados"],
    ["soup", "pasta", "sauce", "pizza", "bacon", "frank", "franks", "hot dog", "hot dogs", "lunchmeat",
     "meatball", "meatballs", "sausage", "sausages"],
    ["deodorant", "haircare", "shampoo", "body wash", "soap", "lotion"],
    ["mop", "mops", "broom", "brooms", "brush", "brushes"],
    ["paper towel", "paper towels", "facial tissue", "bath tissue", "napkin", "napkins", "scrubber",
     "spray bottle"],
    ["bread", "donut", "donuts", "bagel", "bagels", "muffin", "muffins", "bun", "buns"],
    ["pie", "pies", "cake", "cakes", "cheesecake", "cheesecakes", "brownie", "brownies", "cookie", "cookies"],
    ["chip", "chips", "pretzel", "pretzels", "cracker", "crackers", "popcorn", "dip"],
    ["toothpaste", "mouthwash", "floss", "toothbrush"],
    ["condensed milk", "cornbread", "pancake", "waffle", "syrup"],
    ["beer", "cider", "wine", "spirits", "liquor", "whiskey", "vodka"],
]
GROUP_FILLER_WORDS = ["oz", "lb", "ct", "pk", "pack", "select", "varieties", "assorted"]
TITLE_KEYWORDS = [
    "Soda", "Potato Chips", "Tortilla Chips", "Chips", "Cookies", "Cereal", "Sausage", "Bratwurst", "Brats",
    "Shampoo", "Lotion", "Bread", "Dressing", "Broth", "Crackers", "Water", "Tea", "Juice", "Vitamins",
    "Candy", "Dip", "Pasta", "Rice", "Ice Cream", "Coffee", "Cheese", "Spices", "Yogurt", "Snacks", "Sauce",
    "Chicken", "Beef", "Pork", "Fish", "Seafood", "Bacon",
]
TITLE_PACKS = ["12 pk", "6 pk", "8 pk", "15 ct", "Family Size", "Party Size", "1 Liter", "2 Liter"]
TITLE_SMALL_WORDS = ["or", "and", "in", "of", "with", "a", "an", "the"]
TITLE_SEAFOOD = (
    r"\b(?:fish|seafood|salmon|shrimp|tilapia|swordfish|tuna|haddock|swai|whiting|flounder)\b|(?<!cape\s)\bcod\b"
)
TITLE_FILLET = r"\b(?:fillet|filet)s?\b"
TITLE_NOT_SEAFOOD = r"pork|beef|chicken|turkey|steak|chop|loin|chip|pretzel|snack"
TITLE_MEAL_DEAL = "Weekly Meal Deal"
TITLE_HOLIDAY = "Giant Holiday Free Turkey (up to 20 lbs) or Stouffer's / Tofurky Roast"
TITLE_BAKING = "Duncan Hines & PAM • Cake Mixes, Frosting & Baking Spray"
TITLE_VITAMINS = "Nature's Promise & CareOne • Vitamins & Supplements"
TITLE_FLORAL = "Floral • Carnations & Mums (Colors May Vary)"
TITLE_SNACK_BREAD = "Martin's Snacks & Nature's Own • Chips, Popcorn & Bread"
TITLE_FISH = "Fresh & Frozen Seafood Fillets"

# ---- Fixed values: queries that switch the alcohol filter off
ALCOHOL_QUERY_WORDS = [
    "wine", "beer", "alcohol", "liquor", "spirits", "chardonnay", "ipa", "cider", "bud", "coors", "miller",
    "corona", "modelo", "shiner", "prosecco", "champagne",
]
ALCOHOL_CATEGORY_WORDS = ["wine", "beer", "liquor", "spirits", "alcohol"]
ALCOHOL_CATEGORIES = ["wine", "beer", "wine & spirits", "liquor", "spirits"]

# ---- Fixed values: title splitting
TOKEN_UNIT = (
    r"\b(?:Half\s+Gallon|(?:\d+(?:\.\d+)?|\.\d+)(?:\s*-\s*(?:\d+(?:\.\d+)?|\.\d+))?\s*"
    r"(?:oz|ounce|lb|pound|ct|count|pk|pack|qt|quart|pt|pint|gal|gallon|ltr|liter|ml)\.?)\b"
)
CHOICE_COLORS = "Red|Green|Yellow|Zucchini|Black|White|Seedless|Baking|Sweet|Russet"
CHOICE_COLOR_NOUNS = r"Grapes?|Squash|Potato(?:es)?|Apple(?:s)?|Pear(?:s)?|Onion(?:s)?|Pepper(?:s)?"
CHOICE_STYLES = "Shredded|Chunk|Sliced|Block|String|Grated|Crumbled|Whole|Diced|Crushed|Salted|Unsalted"
CHOICE_STYLE_NOUNS = (
    r"Cheese|Cheddar|Mozzarella|Swiss|Provolone|Baby\s+Bella\s+Mushrooms|Mushrooms|Tomato(?:es)?|Butter|Potato(?:es)?"
)
CHOICE_PACKAGED = "Pancakes|Waffles|Bars|Treats|Burgers|Pizzas"
CHOICE_PACKAGED_LEAD = "Frozen|Protein|Organic|Natural|Fresh"
CHOICE_CUTS = (
    "Breasts|Thighs|Drumsticks|Wings|Tenders|Tenderloins|Pork Chops|Pork Loin Chops|Pork Spare Ribs|Whole Chickens"
)
CONTAINER_WORDS = ["tray", "trays", "platter", "platters", "bowl", "bowls", "basket", "baskets"]
BEEF_GRADES = (
    r"USDA\s+Choice(?:\s+Beef)?|USDA\s+Prime(?:\s+Beef)?|USDA\s+Select(?:\s+Beef)?|Certified\s+Angus\s+Beef|"
    r"Chairman's\s+Reserve(?:\s+Beef)?"
)
BEEF_CUTS = [
    r"Chuck\s+Shoulder\s+Roast(?:\s+Bone-in)?", r"Shoulder\s+Roast(?:\s+Bone-in)?",
    r"Beef\s+Short\s+Ribs?(?:\s+Bone-in)?", r"Short\s+Ribs?(?:\s+Bone-in)?", r"Bottom\s+Round(?:\s+Roast)?",
    r"Top\s+Round(?:\s+Roast)?", r"Eye\s+of\s+Round(?:\s+Roast)?", r"Sirloin\s+Tip(?:\s+Roast)?", r"Chuck(?:\s+Roast)?",
    r"Rump(?:\s+Roast)?", r"Tri-Tip(?:\s+Roast)?", r"Ribeye(?:\s+Steak)?", r"Strip\s+Steak", r"T-Bone(?:\s+Steak)?",
]
GROWN_NEXT_BRANDS = (
    r"Dole|Bolthouse|NatureSweet|Fresh\s+Express|Taylor\s+Farms|Our\s+Brand|Earthbound\s+Farm"
)
SALAD_WORD = r"(?!or\b|and\b|Salad\b|Blend\b|Kit\b|Bowl\b)[A-Za-z0-9'&]+"
SALAD_NOUN = (
    r"(?:Salad\s+(?:Blends?|Kits?|Bowls?)(?:\s+or\s+(?:Salad\s+)?(?:Blends?|Kits?|Bowls?))?|"
    r"(?:Salad\s+)?(?:Blends?|Kits?|Bowls?)\s+or\s+(?:Salad\s+)?(?:Blends?|Kits?|Bowls?)|Salad\s+(?:Blends?|Kits?|Bowls?))"
)
PREP_NOUN = (
    r"(?:Baby\s+Bella\s+|White\s+|Portabella\s+|Button\s+)?(?:parfaits?|mushrooms?|crusts?|tortillas?)"
)
PLAIN_WORD = r"(?!or\b|and\b)[A-Za-z0-9'\-]+"
SIZE_TAIL = (
    r"(?:\s+((?:(?:\d+(?:\.\d+)?|\.\d+)(?:\s*-\s*(?:\d+(?:\.\d+)?|\.\d+))?)\s*"
    r"(?:oz|ounce|lb|pound|ct|count|pk|pack|qt|pt|gal)\.?))?"
)
PRODUCE_LIST_NOUNS = "Apples|Potatoes|Grapes|Pears|Citrus|Squash|Tomatoes|Onions|Peppers"
PRODUCE_LIST_HEADS = "Apples|Potatoes|Grapes|Pears|Citrus|Squash"
COUPON_PRODUCT_WORDS = [
    "chips", "crackers", "bread", "milk", "cheese", "soup", "cereal", "meat", "beef", "chicken", "pork", "fruit", "berries",
    "apples", "coffee", "water", "soda", "detergent", "paper", "oil", "sauce", "pasta", "butter", "yogurt", "pizza",
    "ice cream",
]
CAFE_PAIRING = r"\b(?:grande\s+handcrafted\s+drink|handcrafted\s+drink)\b"
CAFE_NAME = "Starbucks Grande Drink & Breakfast or Lunch Food Pairing"
BARE_COUNT = (
    r"^(?:\d+(?:\.\d+)?|\.\d+)\s*(?:ct\.?|count|oz\.?|ounce|lb\.?|pound|pk\.?|pack)(?:\s+minis)?\.?$"
)
BULK_CLAUSE = (
    r"\bSold in (?:a|the)?\s*(\d+(?:\.\d+)?)\s*(lb|oz|ct|count)\.?\s*(?:bag|package|pkg|box|container)?\s+for\s+"
    r"\$(\d+(?:\.\d+)?)\b"
)
COLLAGE_STAPLES = [
    "kraft", "maruchan", "michelina", "idahoan", "bowl", "crest", "banquet", "snack pack", "chef boyardee", "ragu",
]
COLLAGE_NAMES = [
    ("kraft", "Kraft Macaroni & Cheese", "Kraft"), ("maruchan", "Maruchan Yakisoba or Ramen", "Maruchan"),
    ("michelina's", "Michelina's Entree", "Michelina's"), ("idahoan", "Idahoan Mashed Potatoes", "Idahoan"),
    ("bowl", "Maruchan Ramen Bowl", "Maruchan"), ("crest", "Crest Toothpaste", "Crest"),
    ("banquet", "Banquet Pot Pies", "Banquet"), ("snack pack", "Snack Pack Pudding", "Snack Pack"),
    ("chef boyardee", "Chef Boyardee Canned Pasta", "Chef Boyardee"), ("ragu", "Ragu Pasta Sauce", "Ragu"),
]
PORK_NOT_FRESH = [
    "seasoning", "sauce", "marinade", "rice", "beans", "dog food", "treat", "roll", "rolls", "soup", "bratwurst", "hot dog",
]
BERRY_PROCESSED = [
    "tea", "ice cream", "mix", "brownie", "candy", "chocolate", "gummies", "water", "bar",
]
FRESH_STORE_LABELS = ["Signature SELECT", "Signature Farms", "Our Brand", "Giant", "Giant Brand"]
NOT_SHELL_EGGS = (
    r"\b(white|whites|salad|bites|liquid|noodles?|rolls?|waffles?|omelets?|quiche|deli|sub|sandwich|sandwiches|wrap|wraps|"
    r"potato\s+salad|pasta\s+salad|food\s+color|dye|pickled|frittatas?|loaf|dog\s+food|cat\s+food|pet|treats?|skillet|bowl|"
    r"creamer|butter)\b"
)
SHELL_EGGS = r"\b(?<!['’])eggs?\b(?!['’])"
EGG_GRADES = r"\b(large|extra\s+large|jumbo|medium)\b"
FRESH_FLESH = [
    "catfish", "salmon", "tilapia", "cod", "fillet", "chicken", "beef", "pork", "steak", "roast", "loin chop",
]
CUT_WORDS = [
    "ground beef", "ground turkey", "boneless", "skinless", "bone-in", "fresh", "whole", "center cut", "loin chop", "pork chop",
    "ribeye", "sirloin", "t-bone", "filet mignon", "flank steak", "drumsticks", "tenders", "cutlets", "roast", "steak", "chuck",
    "round", "ribs", "short rib", "brisket",
]
CUT_ANIMALS = [
    "chicken", "beef", "pork", "turkey", "salmon", "tilapia", "cod", "catfish", "fillet", "shrimp",
]
PER_POUND_TEXT = (
    r"(?:per\s+lb|sold\s+by\s+the\s+lb|/\s*lb|\$?\d+(?:\.\d+)?\s*/?\s*lb\b|lb\s+member\s+price)"
)
