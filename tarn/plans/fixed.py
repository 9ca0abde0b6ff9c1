"""Word lists and patterns of the field, whole and in their order, which rules must match to agree on a record."""

# Names of treatment works.
TREATMENT_WORKS = (
    "wwtp", "wwtf", "wpcp", "wpcf", "potw", "wastewater treatment", "wastewater reclamation", "wastewater system", "wastewater utility", "water treatment plant", "water treatment facility",
    "water reclamation", "sewage treatment", "sewage lagoon", "sewer lagoon", "wastewater lagoon", "waste water treatment", "treatment lagoon", "water authority", "water district",
    "water utility", "sewer district", "sewer authority", "sanitation district",
)

# What speaks against a facility.
NEGATIVE = (
    "landfill", "transfer station", "materials recovery", "mrf", "recycling center", "recycling facility", "construction debris", "c&d debris", "demolition waste", "concrete recycl",
    "asphalt recycl", "aggregate", "composting facility", "compost site", "yard waste", "green waste", "wood waste", "scrap metal", "scrap yard", "salvage yard", "junkyard", "auto salvage",
    "auto wreck", "tire recycl", "tire disposal", "electronics recycl", "e-waste", "hazardous waste", "rcra", "pcb", "radioactive", "nuclear", "medical waste", "biohazard", "sharps",
    "infectious waste", "pharmaceutical waste", "pathological", "paper mill", "textile recycl", "plastic recycl", "glass recycl", "incinerator", "ammunition", "explosives", "mining",
    "quarry", "gas station", "fuel station", "convenience store", "car wash", "laundromat", "dry cleaner", "animal hospital", "veterinar", "cemetery", "funeral", "cremator",
)

# What speaks for a facility.
POSITIVE = (
    "grease", "fog", "fats oils", "fat oil", "cooking oil", "uco", "used oil", "yellow grease", "brown grease", "trap cleaning", "trap service", "trap pumping", "liquid waste",
    "liquid environmental", "liquid disposal", "non-hazardous liquid", "nonhazardous liquid", "wastewater service", "wastewater hauling", "wastewater hauler", "septic", "cesspool", "pump",
    "vacuum truck", "sewer", "drain", "rooter", "plumbing", "jetting", "hydro", "vac", "rendering", "tallow", "biodiesel", "biofuel", "protein", "meat byproduct", "animal fat",
    "recycling grease", "grease recycling", "oil recovery", "oil recycling", "oil collection", "environmental service", "environmental solution", "environmental management", "porta",
    "portable", "restroom", "catch basin", "storm drain", "industrial cleaning", "industrial service", "wind river", "les", "liquid enviro", "dar pro", "darling", "baker commodit",
    "mahoney", "eazy grease", "happy traps", "barrel energy", "septic blue",
)

# Names of consolidators and what they bought.
CONSOLIDATORS = (
    "liquid environmental", "advance environmental", "advance plumbing", "all city environmental", "atlas pumping", "carolinas resource recovery", "ciro's sewer", "ciros sewer",
    "commercial pumping", "dal-worth", "dalworth", "dover grease", "dover environmental", "flohawks", "giddings hawkins", "gordon's american", "gordons american", "grease masters",
    "green arrow environmental", "lyles grease", "new orleans grease", "newstream", "rite-way industrial", "rite way industrial", "value stream", "affordable bio feedstock",
    "all american grease", "wind river", "seminole septic", "mid south septic", "mid-south septic", "greenway waste", "tcw wastewater", "brockwell", "hapchuk", "keystone wastewater",
    "stanley environmental", "brownie's septic", "brownies septic", "a1 gator", "a-1 gator", "cooke's plumbing", "cookes plumbing", "metro rooter", "metro-rooter", "felix septic",
    "eastern pipe service", "john matthes", "triple t pumping", "koberlein", "m&s septic", "m & s septic", "m and s septic", "fenkner septic", "east coast resources", "b & p environmental",
    "b and p environmental", "liquid assets disposal", "j&m transfer", "j and m transfer", "drummac septic", "hartigan", "earthcare", "kaiser-battistone", "kaiser battistone",
    "kline's services", "klines services", "jim leboeuf", "leboeuf septic", "soucy's septic", "soucys septic", "stright sewage", "oxbury sanitation", "mahopac septic", "hamby's septic",
    "hambys septic", "hamby's commercial", "gibson septic", "select processing of orlando", "tillman septic", "franc environmental", "kbx golden", "affordable pumping", "captain clog drain",
    "dimmick septic", "myers septic", "skyline plumbing", "all florida septic", "drain innovations", "church view septic", "1st choice service", "waste water services inc",
    "a sanitary pumping", "heritage pumping", "parent sanitation", "cloud 9 services", "aa cut rate septic", "rosey's tank", "roseys tank", "r crews", "earth farms organics",
    "baker commodit", "baker rendering", "baker grease", "new leaf biofuel", "western mass rendering", "american by-products", "american by products", "abp recyclers", "darling ingredients",
    "darling international", "dar pro", "dar-pro", "valley proteins", "sanimax", "griffin industries", "rothsay", "craig protein", "carolina by-products", "carolina by products",
    "bakery feeds", "enviroflight", "diamond green diesel", "triple t foods", "mahoney environmental", "crimson renewable", "sequential environmental", "sequential pacific",
    "sequential biofuels", "eazy grease", "dht grease", "relentless renewables", "daytona biodiesel", "cleanfri", "liquid recovery solutions", "green nature recycling",
    "waste resources management", "wrm co", "wrmco", "southwaste", "south waste disposal", "southwaste disposal", "silver city processing", "silver city septic", "silver city plumbing",
    "mcdonald farms", "mcdonald farm", "mcdonald farms enterprises", "trimble grease trap", "barrel energy", "happy traps", "momentum environmental", "septic blue", "heritage-crystal clean",
    "heritage crystal clean", "crystal clean", "patriot environmental", "fcc environmental", "envirosafe services", "denali water", "synagro", "tradebe", "hepaco", "chuck's septic",
    "chucks septic", "cst utilities", "restaurant technologies",
)

# Codes of consolidators.
BRAND_CODES = (
    "LES", "WRE", "BAK", "DAR", "MAH", "MOM", "SEP", "BAR", "EAZ", "WRM", "PE",
)

# How names of municipal bodies begin.
MUNICIPAL_STARTS = (
    "city of ", "county of ", "town of ", "village of ", "borough of ", "township of ",
)

# What names of municipal bodies hold.
MUNICIPAL_PARTS = (
    "water authority", "water district", "sewer district", "sewer authority", "sewerage authority", "sanitation district", "wastewater district", "metropolitan sewer", "regional sewer",
    "municipal utility", "public utilities", "public works",
)

# Patterns of renderers' brands.
RENDERERS = (
    r"\bdarling\b", r"\bdar[\s\-]?pro\b", r"\bbaker\s+commodities\b", r"\bvalley\s+proteins\b", r"\bsanimax\b", r"\bgriffin\s+industries\b", r"\brothsay\b", r"\bcraig\s+protein\b",
)

# Patterns of rendering in a name.
RENDERING = (
    r"\brendering\b", r"\btallow\b", r"\bgrease\b", r"\brecycling\b", r"\bby[\s\-]?products?\b", r"\bprotein\b", r"\bbiofuel\b", r"\bbiodiesel\b", r"\buco\b", r"\bused\s+cooking\s+oil\b",
    r"\boil\s+recovery\b", r"\bfat\s+recovery\b", r"\bhide\s+and\s+tallow\b", r"\bhide\s*&\s*tallow\b", r"\bingredients\b",
)

# Patterns of meat packers in a name.
MEAT = (
    r"\bmeat\s+(co|company|packing|packer)\b", r"\bpacking\s+(co|company)\b", r"\bslaughterhouse\b", r"\bslaughter\s+house\b", r"\bbutcher\b", r"\bsausage\b", r"\bbeef\b", r"\bpork\b",
    r"\bpoultry\b", r"\bchicken\b",
)

# What news of each category speaks of, as alternatives of a pattern.
NEWS = (
    ("M&A", (
        r"\bacqui[srz](?:e|es|ed|ing|ition)?\b", r"\bmerger?(?:s|ed|ing)?\b", r"\bmerges?\b", r"\bmerging\b", r"\bdivest(?:s|ed|iture|ing)?\b", r"\bcarve[\s-]?out\b",
        r"\bplatform\s+investment\b", r"\btuck[\s-]in\b", r"\broll[\s-]up\b", r"\bportfolio\s+(?:add[\s-]on|investment)\b", r"\bcompletes?\s+acquisition\b",
        r"\bpurchase(?:s|d)?\s+(?:assets|operations|business)\b",
    )),
    ("Public Co.", (
        r"\bDarling\s+Ingredients\b", r"\bDarling/?DAR\b", r"\bDAR\s+PRO\b", r"\bDiamond\s+Green\s+Diesel\b", r"\bDGD\b", r"\bGFL\b", r"\bGFL\s+Environmental\b", r"\bClean\s+Harbors\b",
        r"\bHCCI\b", r"\bHeritage[\s-]?Crystal\s*Clean\b", r"\bRepublic\s+Services\b", r"\bWaste\s+Connections\b", r"\bWaste\s+Management\b", r"\b\(NYSE:\s*WM\)", r"\bCasella\b",
        r"\bStericycle\b", r"\bBarrel\s+Energy\b", r"\bBRLL\b", r"\bNeste\b", r"\bGoldman\s+Sachs\b", r"\bVeolia\b", r"\b(?:NYSE|NASDAQ|OTC|TSX|LSE):\s*[A-Z]+\b",
    )),
    ("Renewable Fuels", (
        r"\bUCO\b", r"\bused\s+cooking\s+oil\b", r"\brenewable\s+diesel\b", r"\bSAF\b", r"\bsustainable\s+aviation\s+fuel\b", r"\bRFS\b", r"\brenewable\s+fuel\s+standard\b",
        r"\bRINs?\b(?!\s*g)", r"\bbiodiesel\b", r"\bbiofuel\b", r"\byellow\s+grease\b", r"\bbrown\s+grease\b", r"\btrap\s+grease\b", r"\btallow\b", r"\brendering\b", r"\bLCFS\b",
        r"\blow[\s-]carbon\s+fuel\b", r"\bfeedstock\b.*\b(diesel|aviation|fuel|biodiesel|SAF)\b",
    )),
    ("Regulatory", (
        r"\bFOG\s+(?:ordinance|regulation|program|enforcement|control)\b", r"\b(?:U\.?S\.?\s+)?EPA\b", r"\bpretreatment\b", r"\bsewer\s+(?:ordinance|regulation|use)\b",
        r"\bclean\s+water\s+act\b", r"\bCWA\b", r"\bconsent\s+decree\b", r"\bdischarge\s+permit\b", r"\bcompliance\s+(?:deadline|requirement|date)\b",
        r"\bordinance\b.*\b(grease|FOG|wastewater)\b", r"\b(?:pretreatment|industrial)\s+standards?\b",
    )),
    ("Technology", (
        r"\bIoT\b", r"\bsmart\s+(?:grease\s+trap|trap|sensor|monitor)\b", r"\bgrease\s+trap\s+(?:sensor|monitoring|IoT)\b", r"\bsensor\s+network\b",
        r"\bfleet\s+(?:tech|optimi[sz]ation|management\s+software)\b", r"\broute\s+optimi[sz]ation\b", r"\bbiogas\b", r"\banaerobic\s+digest",
        r"\b(?:electric|EV)\s+(?:truck|vehicle|fleet|garbage)\b", r"\bhydrogen\s+fuel\s+cell\b", r"\bAI[\s-]powered\b", r"\bautomation\b.*\b(waste|collection|truck)\b",
    )),
    ("Labor/Ops", (
        r"\bCDL\b", r"\bcommercial\s+driver(?:'s)?\s+license\b", r"\bdriver\s+shortage\b", r"\bdriver(?:'s)?\s+pay\b", r"\bOSHA\b", r"\bFMCSA\b",
        r"\bDOT\s+(?:regulation|rule|enforcement)\b", r"\binsurance\s+(?:rate|premium|cost)\b", r"\bfleet\s+(?:cost|expense|insurance)\b",
        r"\bworkforce\b.*\b(waste|hauler|trucking|environmental)\b", r"\bwage\b.*\b(driver|hauler|operator)\b",
    )),
    ("Restaurant", (
        r"\brestaurant\s+(?:industry|sector|chains?|operators?)\b", r"\bNational\s+Restaurant\s+Association\b", r"\bNRA\b", r"\bghost\s+kitchen\b",
        r"\bfood[\s-]?service\s+(?:industry|operator|sector)\b", r"\bquick[\s-]service\s+restaurant\b", r"\bQSR\b", r"\bdine[\s-]?in\b.*\btraffic\b", r"\bfull[\s-]service\s+restaurant\b",
    )),
    ("Infrastructure", (
        r"\bWWTP\b", r"\bwastewater\s+treatment\s+(?:plant|facility)\b", r"\bPOTW\b", r"\bIIJA\b", r"\bBipartisan\s+Infrastructure\s+Law\b",
        r"\bInfrastructure\s+Investment\s+and\s+Jobs\s+Act\b", r"\bsewer\s+overflow\b", r"\bSSO\b", r"\bcombined\s+sewer\b", r"\bwater\s+infrastructure\s+(?:fund|grant|funding)\b",
        r"\bsewer\s+(?:upgrade|expansion|capacity)\b", r"\bwater\s+reclamation\b", r"\btreatment\s+plant\s+(?:upgrade|expansion)\b",
    )),
    ("Industry Events", (
        r"\bWWETT\b", r"\bWWETT\s+Show\b", r"\bPumper\s+Show\b", r"\bpumper\.com\b", r"\bWEF\b", r"\bWater\s+Environment\s+Federation\b", r"\bWEFTEC\b", r"\bResiduals\s+and\s+Biosolids\b",
        r"\b(?:industry|trade)\s+(?:conference|show|expo|summit)\b",
    )),
    ("ESG", (
        r"\bcircular\s+economy\b", r"\bsustainability\s+(?:report|reporting|disclosure)\b", r"\bcarbon\s+credit\b", r"\bcarbon\s+offset\b", r"\bScope\s+[123]\s+emissions?\b",
        r"\bnet[\s-]zero\b", r"\bGHG\s+emissions?\b", r"\bgreenhouse\s+gas\s+emissions?\b", r"\bESG\s+(?:report|disclosure|metric|score)\b", r"\bclimate\s+disclosure\b",
    )),
)

# Families of brands (code, owner type, parent) and the patterns of their names, first come first.
FAMILIES = (
    ("LES", "LES (Goldman Sachs)", "Liquid Environmental Solutions", (
        "liquid environmental solutions", "all city environmental", "atlas pumping service", "value stream environmental", "flohawks", "giddings hawkins", "new orleans grease trap",
        "grease masters recycl", "green arrow environmental", "all american grease", "affordable bio feedstock", "carolinas resource recovery", "commercial pumping services",
        "dover grease trap", "newstream environmental",
    )),
    ("WRE", "Wind River (Gryphon)", "Wind River Environmental", (
        "wind river environmental", "seminole septic", "mid south septic|mid-south septic", "greenway waste solutions", "tcw wastewater", "keystone wastewater services", "hapchuk",
        "stanley environmental solutions", "brownie's septic|brownies septic", "a-1 gator wastewater|a1 gator", "cooke's plumbing|cookes plumbing", "metro rooter|metro-rooter",
        "felix septic", "eastern pipe service", "john matthes septic", "triple t pumping", "koberlein environmental", "m&s septic|m and s septic", "fenkner septic", "east coast resources",
        r"b ?\\& ?p environmental|b and p environmental", "liquid assets disposal", r"j ?\\& ?m transfer|j and m transfer", "drummac septic", "hartigan wastewater", "earthcare systems",
        "kaiser-?battistone", "kline's services|klines services", "jim leboeuf septic|leboeuf septic", "soucy's septic|soucys septic", "stright sewage disposal", "oxbury sanitation",
        "mahopac septic", "hamby's septic|hambys septic|hamby's commercial waste", "gibson septic", "select processing of orlando", "tillman septic", "franc environmental", "kbx golden",
        "affordable pumping services", "captain clog", "dimmick septic", "myers septic", "skyline plumbing", "all florida septic", "drain innovations", "church view septic",
        "1st choice service", "waste water services inc", "a sanitary pumping", "heritage pumping", "parent sanitation", "cloud 9 services", "aa cut rate septic",
        "rosey's tank cleaning|roseys tank cleaning", "brockwell['s]? septic",
    )),
    ("BAK", "Baker Commodities", "Baker Commodities", (
        "baker commodit", "baker rendering", "new leaf biofuel", "abp recyclers",
    )),
    ("DAR", "Darling/DAR PRO", "Darling Ingredients / DAR PRO", (
        "darling ingredients", "darling international", r"\bdar pro\b|\bdar-pro\b", "valley proteins", "sanimax", "griffin industries", "diamond green diesel", "bakery feeds",
        "craig protein", "carolina by-?products",
    )),
    ("MAH", "Mahoney/Crimson", "Mahoney Environmental", (
        "mahoney environmental", "crimson renewable", "sequential environmental services",
    )),
    ("EAZ", "Eazy Grease", "Eazy Grease", (
        "eazy grease", "dht grease", "daytona biodiesel", "green nature recycling",
    )),
    ("BAR", "Barrel Energy", "Barrel Energy", (
        "barrel energy", "happy traps",
    )),
    ("MOM", "Momentum Environmental", "Momentum Environmental", (
        "momentum environmental",
    )),
    ("SEP", "Septic Blue (Georgia Oak)", "Septic Blue", (
        "septic blue",
    )),
    ("PE", "PE-Backed: Heritage-Crystal Clean", "Heritage-Crystal Clean", (
        "heritage[- ]crystal clean|crystal clean",
    )),
    ("PE", "PE-Backed: Heritage-Crystal Clean", "Patriot Environmental", (
        "patriot environmental services",
    )),
    ("PE", "PE-Backed: Synagro Technologies", "Synagro Technologies", (
        r"\bsynagro\b",
    )),
    ("PE", "PE-Backed: Denali Water Solutions", "Denali Water Solutions", (
        "denali water solutions",
    )),
    ("PE", "PE-Backed: Tradebe Environmental", "Tradebe Environmental", (
        r"\btradebe\b",
    )),
    ("PE", "PE-Backed: HEPACO (Clean Harbors)", "HEPACO", (
        r"\bhepaco\b",
    )),
    ("PE", "PE-Backed: Chuck's Septic / CST", "Chuck's Septic / CST", (
        "chuck's septic|chucks septic", "cst utilities",
    )),
    ("PE", "PE-Backed: Restaurant Technologies", "Restaurant Technologies", (
        "restaurant technologies",
    )),
)

# Owners of collectors (parent, owner type) and the words of their brands, first come first.
COLLECTOR_OWNERS = (
    ("Wind River Environmental", "Wind River (Gryphon)", (
        "wind river environmental", "seminole septic", "mid south septic", "mid-south septic", "greenway waste solutions", "tcw wastewater", "brockwell", "hapchuk", "keystone wastewater",
        "stanley environmental", "brownie's septic", "brownies septic", "a1 gator", "a-1 gator", "cooke's plumbing", "cookes plumbing", "metro rooter", "metro-rooter", "felix septic",
        "eastern pipe service", "john matthes septic", "triple t pumping", "koberlein environmental", "m&s septic", "m & s septic", "m and s septic", "fenkner septic", "drummac septic",
        "hartigan wastewater", "earthcare", "kaiser-battistone", "kaiser battistone", "kline's services", "klines services", "jim leboeuf septic", "leboeuf septic", "soucy's septic",
        "soucys septic", "stright sewage disposal", "oxbury sanitation", "mahopac septic", "hamby's septic", "hambys septic", "hamby's commercial waste", "gibson septic",
        "select processing of orlando", "tillman septic pumping", "franc environmental", "kbx golden", "affordable pumping services", "captain clog drain", "dimmick septic", "myers septic",
        "skyline plumbing & septic", "all florida septic", "drain innovations", "church view septic", "1st choice service", "b & p environmental", "b and p environmental",
        "waste water services inc", "a sanitary pumping", "heritage pumping", "parent sanitation", "cloud 9 services", "aa cut rate septic", "east coast resources", "liquid assets disposal",
        "j&m transfer", "j and m transfer", "earth farms organics", "rosey's tank cleaning", "roseys tank cleaning",
    )),
    ("Liquid Environmental Solutions", "LES (Goldman Sachs)", (
        "liquid environmental solutions", "advance plumbing", "advance environmental services", "all city environmental", "atlas pumping service", "carolinas resource recovery",
        "ciro's sewer cleaning", "ciros sewer cleaning", "commercial pumping services", "dal-worth industries", "dalworth industries", "dover grease trap", "dover environmental", "flohawks",
        "giddings hawkins", "gordon's american waste", "gordons american waste", "grease masters", "green arrow environmental", "lyles grease trap", "new orleans grease trap", "newstream",
        "rite-way industrial", "rite way industrial", "value stream environmental", "affordable bio feedstock", "all american grease services", "a-1 waste management",
    )),
    ("Darling Ingredients / DAR PRO", "Public: Darling Ingredients (NYSE: DAR)", (
        "darling ingredients", "darling international", "dar pro", "dar-pro", "valley proteins", "sanimax", "griffin industries", "rothsay", "craig protein", "carolina by-products",
        "carolina by products", "bakery feeds", "enviroflight", "diamond green diesel", "triple t foods",
    )),
    ("Baker Commodities", "Baker Commodities", (
        "baker commodities", "baker rendering", "baker grease", "new leaf biofuel", "western mass rendering", "american by-products", "american by products", "abp recyclers",
    )),
    ("Eazy Grease", "Eazy Grease", (
        "eazy grease", "dht grease solutions", "relentless renewables", "daytona biodiesel", "cleanfri", "liquid recovery solutions", "green nature recycling",
    )),
    ("Momentum Environmental", "Momentum Environmental", (
        "momentum environmental",
    )),
    ("Septic Blue", "Septic Blue (Georgia Oak)", (
        "septic blue",
    )),
    ("Barrel Energy", "Public: Barrel Energy (OTC: BRLL)", (
        "barrel energy", "happy traps",
    )),
)

# Words of plants.
PLANT_WORDS = (
    "treatment plant", "treatment facility", "wrf", "wpcp", "wpcf", "rendering", "processing", "disposal", "transfer station", "recycling center", "biofuel", "biodiesel", "biomass",
    "compost", "incinerator", "energy recovery", "wastewater plant", "treatment center", "reclamation",
)

# Words of pumpers.
PUMPER_WORDS = (
    "septic", "pumping", "vacuum", "drain cleaning", "porta-potty", "porta potty", "portable toilet", "portable restroom", "honey", "rooter", "drains",
)

# Words of collectors.
COLLECTING = (
    "grease trap clean", "grease trap service", "grease trap pump", "grease cleaning", "grease service", "grease pumping", "trap cleaning", "trap service", "trap pumping", "septic service",
    "septic pump", "septic tank", "septic clean", "drain cleaning", "drain service", "rooter", "sewer cleaning", "sewer service", "liquid waste service", "liquid waste haul",
    "liquid waste transport", "vacuum truck", "vac truck", "vac service", "portable toilet", "portable sanitation", "porta potty", "porta john", "grease removal", "grease collection",
    "grease hauling", "fog service", "fog cleaning", "fog removal", "cooking oil collection", "cooking oil pickup", "cooking oil recycl", "uco collection", "used oil collection",
    "hydro jetting", "hydro vac", "hydroexcavation", "catch basin clean", "storm drain clean", "pumping service", "pump out service",
)

# Words of collectors that need a strong one beside them.
COLLECTING_WEAK = (
    "plumbing",
)

# Strong ones.
COLLECTING_STRONG = (
    "grease", "septic", "drain", "sewer", "fog", "vacuum",
)

# What speaks against a collector.
NOT_COLLECTING = (
    "landfill", "transfer station", "recycling center", "recycling facility", "materials recovery", "mrf", "solid waste", "refuse", "trash", "garbage", "rubbish", "municipal waste",
    "construction debris", "c&d", "demolition", "concrete recycling", "asphalt", "aggregate", "quarry", "mining", "composting", "compost facility", "yard waste", "green waste", "mulch",
    "wood waste", "biomass", "scrap", "salvage", "auto parts", "junkyard", "wrecking", "tire", "rubber", "electronics", "e-waste", "hazardous waste", "rcra", "pcb", "radioactive", "nuclear",
    "chemical waste", "toxic", "medical waste", "biohazard", "pharmaceutical", "sharps", "pathological", "infectious waste", "stericycle", "paper mill", "textile", "plastic recycling",
    "glass recycling", "metal recycling", "aluminum", "steel", "incinerator", "waste-to-energy", "storage tank", "fuel storage", "petroleum bulk", "gas station", "convenience store",
    "compressor station", "snow dump", "natural gas storage", "car wash", "laundry", "dry cleaner", "animal hospital", "veterinary", "cemetery", "funeral",
)

# Names of treatment works that are no collectors.
NOT_COLLECTING_WORKS = (
    "wwtp", "wwtf", "wpcp", "wpcf", "potw", "wastewater treatment", "wastewater reclamation", "wastewater system", "wastewater utility", "water treatment plant", "water treatment facility",
    "water reclamation", "sewage treatment", "sewage lagoon", "sewer lagoon", "wastewater lagoon", "waste water treatment", "treatment lagoon", "water authority", "water district",
    "water utility", "sewer district", "sewer authority", "sanitation district",
)

# Patterns of municipal bodies that are no collectors.
NOT_COLLECTING_MUNICIPAL = (
    r"\bcity of\b", r"\bcounty of\b", r"\btown of\b", r"\bvillage of\b", r"\bborough of\b", r"\btownship of\b", r"\bmunicipal\b", r"\bpotw\b", r"\bsewerage authority\b",
    r"\butility district\b", r"\bsanitary district\b",
)

# Patterns of owners that need no verification.
CONFIRMED_BRANDS = (
    r"\bdarling\b", r"\bdar[\s\-]?pro\b", r"\bheritage[\s\-]?crystal\s+clean\b", r"\btradebe\b", r"\bsynagro\b", r"\bdenali\s+water\b", r"\bhepaco\b", r"\bwind\s+river\b",
    r"\bles\s*\(goldman\b", r"\bbaker\s+commodities\b", r"\bmahoney\b", r"\bcrimson\b", r"\bneste\b", r"\bgfl\s+environmental\b", r"\bwaste\s+management\b", r"\bclean\s+harbors\b",
    r"\bveolia\b", r"\bbarrel\s+energy\b", r"\bhappy\s+traps\b", r"\beazy\s+grease\b", r"\bdht\s+grease\b", r"\brelentless\s+renewables\b", r"\bdaytona\s+biodiesel\b",
    r"\bwaste\s+resources\s+management\b", r"\bwrm\b", r"\bsouth\s*waste\b", r"\bsilver\s+city\s+processing\b", r"\bmcdonald\s+farms?\b", r"\brestaurant\s+technologies\b",
    r"\bseptic\s+blue\b", r"\bmomentum\s+environmental\b", r"\bchuck'?s\s+septic\b", r"\bcst\b", r"\buniversal\s+environmental\s+services\b", r"\bworld\s+oil\s+environmental\b",
    r"\bvalicor\b", r"\bascension\s+wastewater\b", r"\bnrc\s+environmental\b", r"\bonyx\s+environmental\b", r"\bus\s+ecology\b", r"\bamerican\s+ecology\b", r"\brepublic\s+services\b",
    r"\bstericycle\b",
)

# Patterns of names that need no verification.
CONFIRMED_NAMES = (
    r"\bwastewater\s+treatment\b", r"\bwastewater\s+(facility|plant|district|reclamation)\b", r"\bwwtp\b", r"\bpotw\b", r"\bwater\s+reclamation\b", r"\bwater\s+pollution\s+control\b",
    r"\bsewage\s+treatment\b", r"\bsanitary\s+sewer\b", r"\bsanitary\s+district\b", r"\bgrease\s+trap\b", r"\bgrease\s+(plant|co|company|service)\b",
    r"\brendering\s+(plant|company|services?)?\b", r"\bbiosolids\b", r"\bused\s+cooking\s+oil\b", r"\bporta[\s\-]?potty\b", r"\bportable\s+toilet\b",
    r"\bseptic\s+(tank|service|company|pumping|systems?|cleaning)\b", r"\bseptic\s+(co|llc|inc|sves?)\b", r"\bsewer\s+(cleaning|service|cleaners?|company)\b",
    r"\bvacuum\s+(truck|service|pumping)\b", r"\bliquid\s+waste\s+(hauling|services?|disposal)\b", r"\bgrease\s+recyc", r"\bcooking\s+oil\s+(collection|recycling|recovery)\b",
    r"\byellow\s+grease\b", r"\bbrown\s+grease\b",
)

# Codes of plants and of pumpers.
PLANT_CODES, PUMPER_CODES = ("562219", "311613", "221320"), ("562991",)
