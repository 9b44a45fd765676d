"""Pack size and perishability by rules over food names.

A rule is (words any of which the name must hold, words it must not hold, perishable, default size, refinements); a refinement is (words, size) or
(words, size, perishable), the first that fits counts. ``+`` joins words that must all be there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import any_in, first_of
from .numbers import col

# Pack sizes in grams.
RULES = [
    ("canned,tinned", "", True, 400, [("bean,pea,lentil", 400), ("tuna", 145), ("salmon", 213), ("sardine", 120), ("mackerel", 125), ("tomato", 400), ("corn,sweetcorn", 340), ("soup", 400), ("fruit,peach,pear,pineapple", 410)]),
    ("beef,pork,lamb,veal,venison,bison,goat", "", True, 500, [("mince,ground", 500), ("steak+ribeye,steak+sirloin", 400), ("steak", 350), ("roast,joint", 1000), ("chop", 500), ("rib", 700), ("liver,kidney,heart", 400), ("bacon", 300), ("sausage", 400)]),
    ("chicken,turkey,duck,goose,pheasant,quail", "", True, 500, [("breast", 500), ("thigh,drumstick,leg", 500), ("wing", 500), ("whole", 1500), ("mince,ground", 500), ("liver", 300)]),
    ("ham,bacon,sausage,frankfurter,hot dog,bologna,salami,pepperoni,chorizo,prosciutto", "", True, 200, [("bacon", 300), ("ham", 200), ("sausage,frankfurter,hot dog", 400), ("salami,pepperoni", 100)]),
    ("fish,salmon,cod,haddock,trout,bass,tilapia,pollock,halibut,sole,plaice,herring,carp,catfish,perch,pike,snapper,swordfish,tuna steak,mahi", "", True, 300, [("fillet", 280), ("steak", 300), ("whole", 400), ("smoked", 200)]),
    ("shrimp,prawn,crab,lobster,clam,mussel,oyster,scallop,squid,octopus,mollusk,crustacean", "", True, 200, [("prawn,shrimp", 200), ("mussel", 500)]),
    ("egg", "", True, 360, [("dried,powder", 250, False)]),
    ("milk,cream,yogurt,yoghurt,cheese,butter,margarine", "", True, 500, [("milk+condensed", 400, False), ("milk+powder,milk+dried,milk+evaporated", 400), ("milk", 2000), ("cream", 300), ("yogurt,yoghurt", 500), ("cheese+cottage", 300), ("cream cheese", 200), ("cheese+parmesan,cheese+grated", 100), ("cheese+ricotta", 250), ("cheese", 400), ("butter", 250), ("margarine", 500)]),
    ("tomato,potato,carrot,onion,broccoli,cauliflower,cabbage,spinach,lettuce,kale,pepper,mushroom,cucumber,celery,asparagus,pea,squash,courgette,zucchini,aubergine,eggplant,sweet potato,parsnip,beetroot,turnip,radish,leek,garlic,ginger,artichoke,avocado,brussels,chard,endive,fennel,kohlrabi,okra,rutabaga,shallot,watercress,arugula,rocket,romaine,iceberg", "frozen,canned,dried", True, 400, [("potato", 2500), ("carrot,onion", 1000), ("sweet potato", 1000), ("tomato", 400), ("broccoli", 350), ("cauliflower,cabbage", 500), ("spinach,lettuce,kale", 200), ("pepper", 500), ("mushroom", 250), ("cucumber", 400), ("celery", 400), ("asparagus", 250), ("avocado", 320), ("garlic", 50), ("ginger", 100)]),
    ("frozen+vegetable,frozen+pea,frozen+corn,frozen+broccoli,frozen+spinach,frozen+carrot,frozen+green bean,frozen+mixed", "", True, 900, []),
    ("apple,banana,orange,lemon,lime,grapefruit,pear,peach,plum,apricot,cherry,grape,strawberry,blueberry,raspberry,blackberry,melon,watermelon,pineapple,mango,kiwi,nectarine,papaya,passion,pomegranate,tangerine,clementine,mandarin,cantaloupe,honeydew,fig,date,cranberry,currant,gooseberry,guava,lychee,persimmon,quince,starfruit", "dried,canned,juice", True, 500, [("apple,orange,pear", 1000), ("banana", 750), ("grape", 500), ("strawberry", 400), ("blueberry,raspberry,blackberry", 150), ("melon,watermelon", 2000), ("pineapple", 1000), ("mango", 400), ("lemon,lime", 250), ("grapefruit", 600)]),
    ("dried,raisin,prune,date", "", False, 250, []),
    ("fig", "raw", False, 250, []),
    ("bean,lentil,chickpea,pea,cowpea,soybean", "", True, 400, [("dried,raw,mature", 500, False)]),
    ("tofu,tempeh,soy", "", True, 280, []),
    ("rice,pasta,noodle,couscous,quinoa,bulgur,barley,millet,polenta,farro,spelt", "", False, 1000, [("noodle", 500)]),
    ("cereal,oat,granola,muesli", "", False, 500, []),
    ("flour,cornmeal,baking", "", False, 1500, []),
    ("bread,roll,bagel,muffin,croissant,biscuit,cracker,tortilla,pita,naan,flatbread", "", True, 400, [("cracker,crisp", 200, False)]),
    ("cookie,cake,pie,pastry,brownie,donut", "", True, 300, []),
    ("nut,almond,walnut,cashew,peanut,pistachio,hazelnut,pecan,macadamia,brazil,chestnut", "", False, 200, []),
    ("seed,sunflower,pumpkin,chia,flax,sesame", "", False, 200, []),
    ("oil", "", False, 500, []),
    ("sauce,salsa,dressing,mayonnaise,ketchup,mustard,gravy,marinade,vinegar", "", False, 300, [("ready-to-serve,jar", 500, True)]),
    ("soup", "", True, 500, []),
    ("juice", "", True, 1000, []),
    ("beverage,drink,soda,cola,tea,coffee", "", True, 500, [("alcoholic,wine,beer,spirit", 750, False), ("tea,coffee", 250, False)]),
    ("candy,chocolate,snack,chip,crisp,popcorn,pretzel", "", False, 150, []),
    ("pudding,custard,mousse", "", True, 150, []),
    ("ice cream,frozen", "", True, 500, []),
    ("peanut butter,almond butter", "", False, 340, []),
    ("jam,jelly,marmalade,preserve", "", False, 454, []),
    ("honey", "", False, 340, []),
    ("hummus", "", True, 300, []),
    ("spice,seasoning,herb", "", False, 50, []),
    ("pepper", "bell", False, 50, []),
    ("sugar,syrup,molasses", "", False, 340, [("sugar", 1000)]),
    ("bar,protein", "", False, 60, []),
]


def _holds(text: Column, words: str) -> Column:
    """Any of the words separated by commas; those joined by + must all be there."""
    single = [w for w in words.split(",") if w and "+" not in w]
    test = any_in(text, single) if single else F.lit(False)
    for group in (w for w in words.split(",") if "+" in w):
        all_there = F.lit(True)
        for w in group.split("+"):
            all_there = all_there & any_in(text, [w])
        test = test | all_there
    return test


def portion(name: Column | str, rules: list[tuple] = RULES, otherwise: tuple[int, bool] = (100, False)) -> Column:
    """struct<pack_size int, perishable boolean> of the first rule that fits a name."""
    text = F.lower(col(name))
    value = lambda size, perishable: F.struct(F.lit(int(size)).alias("pack_size"), F.lit(perishable).alias("perishable"))
    tests = []
    for words, never, perishable, size, finer in rules:
        test = _holds(text, words)
        if never:
            test = test & ~any_in(text, never.split(","))
        inner = first_of([(_holds(text, f[0]), value(f[1], f[2] if len(f) > 2 else perishable)) for f in finer], value(size, perishable))
        tests.append((test, inner))
    return first_of(tests, value(*otherwise))
