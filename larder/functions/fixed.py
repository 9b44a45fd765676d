"""Word lists, tables and limits that results depend on, as they must be, in their order."""

# Exact category names and substrings of category names, by label.
#: Categories of supplements.
SUPPLEMENT_CATEGORIES = [
    "protein powders", "protein bars", "protein shakes", "meal replacements", "dietary supplements", "food supplements", "sports drinks",
    "energy drinks", "energy bars", "vitamins", "minerals supplements", "weight gainers", "pre-workout", "baby foods", "baby milks", "infant formula",
    "slimming products", "diet shakes",
]

#: Categories of composite dishes.
COMPOSITE_CATEGORIES = [
    "pizzas", "pizza", "pies", "quiches", "lasagnes", "lasagna", "sandwiches", "wraps", "burritos", "tacos", "meals", "ready meals",
    "microwave meals", "frozen meals", "meals with chicken", "meals with meat", "meals with fish", "prepared dishes", "prepared meals",
    "one-dish meals", "salads", "prepared salads", "mixed salads", "soups", "stews", "curries", "curry", "chilli", "pasta dishes", "noodle dishes",
    "rice dishes", "sushi", "dim sum", "spring rolls", "pot noodles", "instant noodles", "meal kits", "cooking kits", "shepherds pie", "cottage pie",
    "fish pie", "moussaka", "risotto", "paella", "biryani", "fajitas", "enchiladas", "quesadillas", "stuffed", "filled", "topped",
]

#: Categories of single foods.
SINGLE_CATEGORIES = [
    "milks", "milk", "butters", "butter", "creams", "cream", "cheddar cheese", "mozzarella", "gouda", "brie", "camembert", "feta", "stilton",
    "parmesan", "edam", "gruyere", "cream cheese", "cottage cheese", "eggs", "egg", "apples", "bananas", "oranges", "lemons", "limes", "grapes",
    "strawberries", "blueberries", "raspberries", "tomatoes", "potatoes", "onions", "carrots", "peppers", "mushrooms", "spinach", "broccoli",
    "cauliflower", "courgettes", "aubergines", "avocados", "cucumbers", "lettuce", "kale", "cabbage", "peas", "sweetcorn", "garlic", "ginger",
    "chillies", "fresh fruits", "fresh vegetables", "frozen vegetables", "chickens", "chicken breasts", "chicken thighs", "beef", "pork", "lamb",
    "mince", "steaks", "salmon", "cod", "tuna", "prawns", "haddock", "mackerel", "sardines", "anchovies", "trout", "smoked salmon", "rice", "pasta",
    "noodles", "couscous", "flours", "flour", "oats", "oat", "sugars", "sugar", "salt", "salts", "olive oils", "sunflower oils", "coconut oils",
    "vegetable oils", "cooking oils", "oils", "almonds", "walnuts", "cashews", "peanuts", "hazelnuts", "pistachios", "pecans", "brazil nuts",
    "macadamia nuts", "chia seeds", "flaxseeds", "sunflower seeds", "pumpkin seeds", "sesame seeds", "mixed nuts", "nuts", "chickpeas", "lentils",
    "kidney beans", "black beans", "baked beans", "beans", "pulses", "spices", "herbs", "dried herbs", "honey", "maple syrup", "vinegars", "vinegar",
    "tofu", "tempeh", "coconut milk", "almond milk", "oat milk", "soy milk", "water", "mineral water", "sparkling water", "tea", "teas", "coffee",
    "coffees", "cocoa powder", "baking powder", "dried fruits", "raisins", "dates", "prunes",
]

#: Categories of processed foods.
CATEGORY_CATEGORIES = [
    "biscuits", "cookies", "crackers", "crackers (appetizers)", "breads", "bread", "rolls", "bagels", "naan", "cakes", "muffins", "pastries",
    "croissants", "doughnuts", "yogurts", "yoghurts", "fromage frais", "cheeses", "cereals", "breakfast cereals", "mueslis", "granola", "crisps",
    "potato crisps", "salted snacks", "salted-snacks", "snacks", "sweet snacks", "chocolates", "chocolate candies", "dark chocolates",
    "milk chocolates", "candies", "confectioneries", "sweets", "ice creams", "ice cream", "frozen desserts", "sausages", "bacon", "ham",
    "prepared meats", "hummus", "dips", "jams", "marmalades", "spreads", "nut butters", "peanut butter", "ketchup", "mayonnaise", "mustard", "sauces",
    "pasta sauces", "cooking sauces", "juices", "fruit juices", "smoothies", "sodas", "soft drinks", "sweetened beverages", "plant-based beverages",
    "plant-based foods", "meat analogues", "plant-based meats", "canned foods", "canned vegetables", "canned fruits", "frozen foods", "dried pasta",
    "toppings-ingredients", "condiments", "cereals and their products", "beverages", "groceries", "undefined",
]

#: Parts of category or product names of supplements.
SUPPLEMENT_KEYWORDS = [
    "protein powder", "protein isolate", "whey protein", "protein bar", "protein shake", "meal replacement", "diet shake", "slimming",
    "weight gainer", "pre workout", "pre-workout", "bcaa", "creatine", "baby food", "infant formula", "baby milk", "multivitamin", "supplement",
    "vitamin tablet", "collagen", "matcha collagen",
]

#: Parts of category names of composite dishes.
COMPOSITE_KEYWORDS = [
    "ready meal", "microwave meal", "frozen meal", "meal deal", "meal for", "serves 2", "family meal", "meal kit", "pie filling", "stir fry",
    "stir-fry", "shepherdless pie", "shepherd pie", "shepherd's pie", "cottage pie", "fish pie", "chicken pie", "lasagne", "lasagna", "moussaka",
    "risotto", "curry", "biryani", "tikka masala", "korma", "jalfrezi", "burrito", "fajita", "enchilada", "taco", "sushi", "dim sum", "spring roll",
    "noodle soup",
]

#: Parts of category names of single foods.
SINGLE_KEYWORDS = [
    "raw chicken", "chicken breast", "chicken thigh", "raw beef", "beef mince", "steak", "raw salmon", "salmon fillet", "cod fillet", "whole milk",
    "semi skimmed milk", "skimmed milk", "olive oil", "sunflower oil", "coconut oil", "rapeseed oil", "plain flour", "self raising flour",
    "wholemeal flour", "basmati rice", "long grain rice", "brown rice", "caster sugar", "granulated sugar", "brown sugar", "icing sugar",
    "salted butter", "unsalted butter", "free range eggs", "large eggs", "medium eggs", "natural yogurt", "greek yogurt", "plain yogurt",
    "double cream", "single cream", "clotted cream", "table salt", "sea salt", "rock salt", "balsamic vinegar", "white wine vinegar", "cider vinegar",
    "soy sauce", "worcestershire sauce",
]

#: Parts of category names of processed foods.
CATEGORY_KEYWORDS = [
    "biscuit", "cookie", "cracker", "wafer", "bread", "roll", "bagel", "pitta", "tortilla", "cake", "muffin", "brownie", "flapjack", "cereal",
    "muesli", "granola", "porridge", "crisp", "chip", "pretzel", "popcorn", "chocolate", "candy", "sweet", "toffee", "fudge", "sausage",
    "frankfurter", "hot dog", "ice cream", "sorbet", "gelato", "jam", "marmalade", "spread", "sauce", "ketchup", "mayo", "mustard", "dressing",
    "juice", "squash", "cordial", "smoothie", "yogurt", "yoghurt", "hummus", "houmous",
]

# Parts of product names, by label.
#: Dishes.
COMPOSITE_NAMES = [
    "sandwich", "wrap", "panini", "sub roll", "pizza", "calzone", "pie", "pasty", "pastie", "quiche", "tart", "lasagne", "lasagna", "moussaka",
    "cannelloni", "risotto", "paella", "biryani", "pilau", "curry", "korma", "tikka masala", "jalfrezi", "madras", "vindaloo", "balti", "bhuna",
    "stir fry", "stir-fry", "chow mein", "chop suey", "burrito", "fajita", "enchilada", "taco", "quesadilla", "nacho", "sushi", "dim sum",
    "spring roll", "samosa", "pakora", "bhaji", "casserole", "hotpot", "hot pot", "stew", "soup", "broth", "chowder", "bisque", "ravioli",
    "tortellini", "gnocchi", "salad", "meal", "dinner", "lunch", "noodle soup", "pot noodle", "cup noodle", "cheesecake", "tiramisu", "trifle",
    "pavlova", "gateau", "corndog", "corn dog", "with sauce", "in sauce", "in gravy", "with rice", "with chips", "with noodles", "with pasta",
    "topped with", "stuffed with", "filled with", "served with",
]

#: Names that only look like dishes.
FALSE_COMPOSITE_NAMES = [
    "curry powder", "curry paste", "curry sauce", "pie crust", "pie shell", "pastry case", "soup mix", "salad leaf", "salad leaves", "pizza base",
    "pizza dough", "taco shell", "taco seasoning", "sandwich bread", "sandwich thins",
]

#: Names that are no single food.
NOT_SINGLE_NAMES = [
    "battered", "breaded", "coated", "crumbed", "crusted", "flavoured", "flavored", "seasoned", "marinated", "glazed", "stuffed", "filled", "topped",
    "loaded", "dippers", "nuggets", "goujons", "strips", "bites", "poppers", "kebab", "skewer", "burger", "patty", "pattie", "cake", "pie", "roll",
    "pasty", "croquette", "fritter", "tempura", "kiev", "parmigiana", "schnitzel", "escalope", "spread", "paste", "pate", "bar ", " bar", "balls",
    "fingers", "mix", "medley", "selection", "and ", " and ", "with ", "in ",
]

#: Single foods.
SINGLE_NAMES = [
    "whole milk", "semi skimmed milk", "skimmed milk", "1% milk", "salted butter", "unsalted butter", "butter block", "double cream", "single cream",
    "whipping cream", "clotted cream", "soured cream", "free range eggs", "large eggs", "medium eggs", "barn eggs", "cheddar", "mozzarella",
    "parmesan", "stilton", "brie", "camembert", "gouda", "edam", "gruyere", "feta", "halloumi", "mascarpone", "ricotta", "cream cheese",
    "cottage cheese", "red leicester", "wensleydale", "natural yogurt", "greek yogurt", "plain yogurt", "chicken breast", "chicken thigh",
    "chicken drumstick", "chicken wing", "whole chicken", "chicken fillet", "diced chicken", "chicken legs", "beef mince", "steak", "beef joint",
    "sirloin", "ribeye", "rump", "pork chop", "pork loin", "pork belly", "pork joint", "pork ribs", "pork mince", "diced pork", "lamb chop",
    "lamb leg", "lamb mince", "diced lamb", "lamb shank", "turkey breast", "turkey mince", "duck breast", "salmon fillet", "cod fillet",
    "haddock fillet", "sea bass fillet", "tuna steak", "mackerel fillet", "trout fillet", "plaice fillet", "smoked salmon", "smoked haddock",
    "smoked mackerel", "raw prawns", "king prawns", "tiger prawns", "plain flour", "self raising flour", "wholemeal flour", "strong bread flour",
    "basmati rice", "long grain rice", "brown rice", "jasmine rice", "risotto rice", "caster sugar", "granulated sugar", "brown sugar", "icing sugar",
    "demerara sugar", "olive oil", "sunflower oil", "coconut oil", "rapeseed oil", "vegetable oil", "sea salt", "rock salt", "table salt",
    "balsamic vinegar", "white wine vinegar", "cider vinegar", "malt vinegar", "soy sauce", "worcestershire sauce", "dried pasta", "spaghetti",
    "penne", "fusilli", "tagliatelle", "linguine", "egg noodles", "rice noodles", "udon noodles", "porridge oats", "rolled oats", "jumbo oats",
    "baking powder", "bicarbonate of soda", "cocoa powder", "coconut milk", "almond milk", "oat milk", "soy milk", "soya milk", "chopped tomatoes",
    "tinned tomatoes", "cherry tomatoes", "plum tomatoes", "baked beans", "cannellini beans", "kidney beans", "black beans", "butter beans",
    "garden peas", "frozen peas", "mushy peas", "marrowfat peas", "chickpeas", "red lentils", "green lentils", "puy lentils", "frozen sweetcorn",
    "sweetcorn", "pitted olives", "green olives", "black olives", "cashew nut", "almond", "walnut", "peanut", "hazelnut", "mixed nuts", "cashew",
    "pistachio", "pecan", "brazil nut", "chia seed", "pumpkin seed", "sunflower seed", "sesame seed", "peanut butter", "almond butter",
    "cashew butter", "mineral water", "sparkling water", "still water", "green tea", "black tea", "herbal tea", "rooibos", "ground coffee",
    "instant coffee", "coffee bean", "honey", "maple syrup", "golden syrup", "treacle", "tofu", "tempeh", "dried fruit", "raisins", "dates", "prunes",
    "dried apricot", "desiccated coconut", "coconut cream",
]

#: Processed foods.
CATEGORY_NAMES = [
    "biscuit", "cookie", "cracker", "wafer", "shortbread", "bread", "bap", "bagel", "pitta", "tortilla", "naan", "flatbread", "crumpet", "cake",
    "muffin", "brownie", "flapjack", "scone", "doughnut", "donut", "cereal", "muesli", "granola", "crisp", "pretzel", "popcorn", "chocolate", "candy",
    "toffee", "fudge", "marshmallow", "sausage", "frankfurter", "ice cream", "sorbet", "gelato", "lolly", "lollies", "jam", "marmalade", "jelly",
    "ketchup", "mayo", "mayonnaise", "mustard", "dressing", "relish", "juice", "squash", "cordial", "smoothie", "milkshake", "yogurt", "yoghurt",
    "hummus", "houmous", "tzatziki", "guacamole", "salsa", "bacon", "ham", "chorizo", "salami", "pepperoni", "prosciutto", "cola", "lemonade",
    "tonic", "ginger beer", "soda", "cider", "beer", "lager", "ale", "wine", "vodka", "gin", "whisky", "rum", "spread", "paste", "soup",
]

# Parts of food names by kind.
#: Red meat.
RED_MEAT = [
    "beef", "steak", "ground beef", "veal", "lamb", "mutton", "pork", "ham", "bacon", "sausage", "hot dog", "frankfurter", "salami", "pepperoni",
    "chorizo", "prosciutto", "pancetta", "goat", "bison", "venison", "game",
]

#: Processed meat.
PROCESSED_MEAT = [
    "bacon", "sausage", "hot dog", "frankfurter", "salami", "pepperoni", "chorizo", "prosciutto", "pancetta", "ham", "deli", "luncheon", "bologna",
    "pastrami", "corned beef",
]

#: Dried spices.
DRIED_SPICE = [
    "spices,", "paprika", "turmeric", "cumin", "coriander", "cinnamon", "nutmeg", "cloves", "cardamom", "pepper, black", "pepper, white",
    "chili powder", "cayenne", "curry powder", "garam masala", "oregano, dried", "thyme, dried", "basil, dried", "rosemary, dried", "garlic powder",
    "onion powder", "mustard seed", "fennel seed", "caraway", "allspice", "bay leaf", "sage, ground",
]

#: Fresh herbs.
FRESH_HERB = [
    "parsley, fresh", "cilantro", "basil, fresh", "mint, fresh", "thyme, fresh", "rosemary, fresh", "dill, fresh", "chives", "tarragon",
    "sage, fresh", "oregano, fresh",
]

#: Sauces.
SAUCE = [
    "soy sauce", "teriyaki", "worcestershire", "hot sauce", "vinegar", "ketchup", "mayonnaise", "salsa", "pesto", "hummus", "tahini", "harissa",
    "sriracha", "fish sauce", "oyster sauce", "hoisin", "bbq sauce", "tomato sauce", "pasta sauce", "marinara", "dressing,", "ranch", "caesar",
]

#: Micronutrients balanced by day.
DAILY_MICROS = [
    "Vitamin A (mcg RAE)", "Vitamin C (mg)", "Vitamin E (mg)", "Folate (mcg DFE)", "Vitamin B12 (mcg)", "Iron (mg)", "Calcium (mg)", "Potassium (mg)",
    "Magnesium (mg)", "Zinc (mg)",
]

# Regular expressions of foods that plans never use.
#: Any of these in the lower-cased name excludes a food.
EXCLUDED_NAMES = [
    "industrial", "leavening agent", "seed gum", "gums, seed", "guar gum", "gum", "infant formula", "medical food", "meat extender", "formulated bar",
    "protein isolate", "whey protein", "soy protein", "casein", "oil, industrial", "shortening", "margarine-like", "butter replacement",
    "egg substitute", "imitation", "analogue", "test sample", "experimental", "breakfast type, low calorie", "breakfast type, powder",
    "fruit-flavored drink, powder", "orange-flavor drink", "instant breakfast", "drink mix, powder", "beverages, fruit punch-flavor drink",
    "beverages, grape drink", "sports drink", "energy drink", "meal replacement", "nutritional supplement", "fortified", "liver", "giblets",
    "gizzard", "canned, condensed", "canned, prepared", "canned, ready-to-serve", "soup, canned", "soup, instant", "frozen dinner", "frozen meal",
    "frozen entree", "tv dinner", "microwave meal", "ready-to-eat", "heat and serve", "meal kit", "game meat", "squirrel", "bison", "elk", "deer",
    "venison", "rabbit", "moose", "bear", "caribou", "antelope", "wild boar", "horse", "frog legs", "turtle", "alligator", "ostrich", "emu", "quail",
    "pheasant", "chiton", "alaska native", "new zealand", "variety meats", "by-products", "blood", "brain", "tongue", "heart", "kidney", "tripe",
    "sweetbreads", "intestine", "chitlins", "bone marrow", "spleen", "lungs", "acerola", "drumstick leaves", "amaranth leaves", "jute, potherb",
    "new zealand spinach", "vinespinach", "pumpkin leaves", "sweet potato leaves", "cress, garden", "dock, raw", "prairie turnip", "agave, raw",
    "nopales", "mollusks, snail", "sea cucumber", "baby food", "gerber", "stage 1", "stage 2", "toddler", "restaurant", "fast food", "school lunch",
    "hospital", "pastelitos", "apache", "luxury loaf", "yeast extract", "dried.*egg", "egg.*dried", "powder", "isolate", "concentrate", "defatted",
    "low fat.*flour", "industrial", "shortening", "beverage", "drink", "shake", "supplement", "rennet", "vital wheat gluten", "pectin", "lecithin",
    "gelatin, dry", "dried whole egg", "egg yolk, dried", "flour, soy", "oil, flaxseed, contains added",
]

# Words without meaning in product names.
#: Filler words and shops.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "with", "without", "in", "on", "raw", "cooked", "fresh", "frozen", "canned", "dried", "packed", "drained", "added",
    "prepared", "made", "from", "whole", "sliced", "chopped", "ground", "minced", "organic", "natural", "free", "range", "british", "tesco",
    "sainsbury", "asda", "morrisons", "waitrose", "aldi", "lidl",
]

# Pack sizes in grams by the first word that a product name and category hold.
#: Sizes, the usual one first; else 400.
PACK_SIZES = {
    "chicken": [300, 500, 1000],
    "beef": [250, 500, 750],
    "pork": [300, 500],
    "lamb": [400, 500],
    "sausage": [400, 454],
    "bacon": [200, 300],
    "fish": [280, 400],
    "salmon": [200, 280, 400],
    "tuna": [160, 200],
    "eggs": [360, 720],
    "milk": [568, 1136, 2272, 3408],
    "cheese": [200, 400, 550],
    "yogurt": [125, 450, 500],
    "butter": [250, 500],
    "cream": [150, 300, 600],
    "bread": [400, 800],
    "pasta": [500, 1000],
    "rice": [500, 1000, 2000],
    "cereal": [375, 500, 750],
    "oats": [500, 1000],
    "flour": [500, 1500],
    "potato": [1000, 2500],
    "carrot": [500, 1000],
    "onion": [500, 1000],
    "tomato": [250, 400],
    "broccoli": [200, 350],
    "spinach": [100, 200],
    "apple": [500, 600],
    "banana": [500],
    "orange": [500, 800],
    "beans": [400, 415],
    "lentils": [400, 500],
    "chickpeas": [400],
}

# Descriptors (origin | state | process).
#: By food category.
USDA_DESCRIPTORS = {
    "Legumes and Legume Products": "plant | variable | variable",
    "Vegetables and Vegetable Products": "plant | variable | variable",
    "Fruits and Fruit Juices": "plant | variable | variable",
    "Cereal Grains and Pasta": "plant | processed | milled",
    "Baked Products": "plant | processed | baked",
    "Breakfast Cereals": "plant | processed | manufactured",
    "Nut and Seed Products": "plant | raw | whole",
    "Spices and Herbs": "plant | dried | ground",
    "Fats and Oils": "mixed | processed | extracted",
    "Dairy and Egg Products": "animal | variable | variable",
    "Beef Products": "animal | raw | whole",
    "Pork Products": "animal | raw | whole",
    "Poultry Products": "animal | raw | whole",
    "Lamb, Veal, and Game Products": "animal | raw | whole",
    "Sausages and Luncheon Meats": "animal | processed | cured",
    "Finfish and Shellfish Products": "animal | raw | whole",
    "Soups, Sauces, and Gravies": "mixed | processed | cooked",
    "Sweets": "mixed | processed | manufactured",
    "Beverages": "mixed | liquid | variable",
    "Snacks": "mixed | processed | manufactured",
    "Baby Foods": "mixed | processed | manufactured",
    "Meals, Entrees, and Side Dishes": "mixed | processed | cooked",
    "American Indian/Alaska Native Foods": "mixed | variable | variable",
}

#: By food group.
FOODB_DESCRIPTORS = {
    "Vegetables": "plant | variable | variable",
    "Fruits": "plant | raw | whole",
    "Herbs and Spices": "plant | dried | ground",
    "Nuts": "plant | raw | whole",
    "Cereals and cereal products": "plant | processed | milled",
    "Pulses": "plant | variable | variable",
    "Soy": "plant | variable | variable",
    "Teas": "plant | processed | brewed",
    "Coffee": "plant | processed | brewed",
    "Cocoa": "plant | processed | manufactured",
    "Gourds": "plant | raw | whole",
    "Baking goods": "plant | processed | manufactured",
    "Animal foods": "animal | variable | variable",
    "Milk and milk products": "animal | variable | variable",
    "Eggs": "animal | raw | whole",
    "Aquatic foods": "animal | raw | whole",
    "Fats and oils": "mixed | processed | extracted",
    "Beverages": "mixed | liquid | variable",
    "Snack foods": "mixed | processed | manufactured",
    "Confectioneries": "mixed | processed | manufactured",
    "Dishes": "mixed | processed | cooked",
    "Baby foods": "mixed | processed | manufactured",
}

#: Words of a description, in order of precedence, with their descriptor.
KEYWORD_DESCRIPTORS = [
    (
        ["beef", "steak", "mince", "veal", "lamb", "pork", "bacon", "ham", "sausage", "gammon"],
        "animal | variable | variable",
    ),
    (
        ["chicken", "turkey", "duck", "goose", "poultry"],
        "animal | variable | variable",
    ),
    (
        ["fish", "cod", "salmon", "tuna", "mackerel", "haddock", "prawn", "crab", "lobster", "mussel", "oyster", "shellfish", "sardine", "anchov"],
        "animal | variable | variable",
    ),
    (
        ["milk", "cheese", "yoghurt", "yogurt", "cream", "butter", "curd", "whey"],
        "animal | variable | variable",
    ),
    (
        ["egg"],
        "animal | raw | whole",
    ),
    (
        ["bread", "flour", "pasta", "rice", "noodle", "cereal", "oat", "wheat", "barley", "rye", "corn", "maize"],
        "plant | processed | milled",
    ),
    (
        ["cake", "biscuit", "pastry", "scone", "muffin", "crumpet", "croissant", "pie"],
        "plant | processed | baked",
    ),
    (
        ["apple", "banana", "orange", "grape", "pear", "berry", "melon", "mango", "peach", "plum", "cherry", "fruit", "lemon", "lime", "kiwi",
         "apricot", "fig", "date", "raisin", "sultana", "prune", "rhubarb"],
        "plant | raw | whole",
    ),
    (
        ["potato", "carrot", "onion", "tomato", "pepper", "broccoli", "cabbage", "spinach", "lettuce", "pea", "bean", "lentil", "chickpea",
         "vegetable", "mushroom", "courgette", "aubergine", "cauliflower", "sweetcorn", "asparagus", "celery", "cucumber", "leek", "turnip", "swede",
         "parsnip", "beetroot", "sprout"],
        "plant | variable | variable",
    ),
    (
        ["nut", "almond", "walnut", "cashew", "peanut", "hazelnut", "pistachio", "seed", "sesame", "sunflower"],
        "plant | raw | whole",
    ),
    (
        ["oil", "margarine", "lard", "dripping", "shortening", "ghee"],
        "mixed | processed | extracted",
    ),
    (
        ["sugar", "chocolate", "sweet", "toffee", "candy", "honey", "jam", "marmalade", "syrup", "treacle", "fudge"],
        "mixed | processed | manufactured",
    ),
    (
        ["beer", "wine", "spirit", "lager", "cider", "ale", "whisky", "gin", "vodka", "rum", "brandy", "liqueur", "port", "sherry", "stout"],
        "mixed | liquid | alcoholic",
    ),
    (
        ["juice", "squash", "cordial", "water", "tea", "coffee", "cocoa", "drink", "cola", "lemonade", "tonic"],
        "mixed | liquid | variable",
    ),
    (
        ["sauce", "gravy", "soup", "stock", "ketchup", "mayonnaise", "dressing", "pickle", "chutney", "vinegar", "mustard"],
        "mixed | processed | cooked",
    ),
    (
        ["herb", "spice", "pepper", "salt", "cinnamon", "ginger", "garlic", "curry", "chilli", "thyme", "rosemary", "basil", "mint", "parsley",
         "oregano", "cumin", "nutmeg", "coriander", "dill", "sage", "paprika", "turmeric"],
        "plant | dried | ground",
    ),
]

# Recommended daily amounts for coverage scores.
#: By nutrient.
RDA = {
    "protein": 50,
    "carbohydrate": 275,
    "fat": 65,
    "Fiber (g)": 28,
    "Sugar (g)": 50,
    "Saturated Fat (g)": 20,
    "Monounsaturated Fat (g)": 20,
    "Polyunsaturated Fat (g)": 15,
    "Vitamin A (mcg RAE)": 900,
    "Vitamin C (mg)": 90,
    "Vitamin D (mcg)": 15,
    "Vitamin E (mg)": 15,
    "Vitamin K (mcg)": 120,
    "Thiamin (B1) (mg)": 1.2,
    "Riboflavin (B2) (mg)": 1.3,
    "Niacin (B3) (mg NE)": 16,
    "Vitamin B6 (mg)": 1.7,
    "Folate (mcg DFE)": 400,
    "Vitamin B12 (mcg)": 2.4,
    "Pantothenic Acid (mg)": 5,
    "Choline (mg)": 550,
    "Calcium (mg)": 1000,
    "Iron (mg)": 8,
    "Magnesium (mg)": 420,
    "Phosphorus (mg)": 700,
    "Potassium (mg)": 4700,
    "Sodium (mg)": 2300,
    "Zinc (mg)": 11,
    "Copper (mg)": 0.9,
    "Manganese (mg)": 2.3,
    "Selenium (mcg)": 55,
}
