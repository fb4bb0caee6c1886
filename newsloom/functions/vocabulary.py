"""Word lists, patterns and lookup tables that results depend on."""

# --- fixed values: URLs -------------------------------------------------------------------------

TRACKING_PARAMETERS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid"]

DISPLAY_SUFFIXES = ["com", "net", "org", "io", "co", "gg", "tv", "info", "biz", "me", "de", "fr", "it", "es", "us", "ca", "au", "uk", "co.uk"]

HOST_SUFFIXES = ["com", "net", "org", "io", "co", "gg", "tv", "uk"]

IMAGE_REJECT_WORDS = [
    "logo", "favicon", "gravatar", "placeholder", "site-icon", "blank.", "blank-", "advert", "advertisement", "site-branding", "site-logo",
    "wccftech-website", "no-box-art", "no_box_art", "no-image", "noimage", "no-image-available",
]

SITE_NAMES = {
    "ign.com": "IGN", "gamespot.com": "GameSpot", "pcgamer.com": "PC Gamer", "wccftech.com": "Wccftech", "eurogamer.net": "Eurogamer",
    "gameinformer.com": "Game Informer", "vg247.com": "VG247", "gamesradar.com": "GamesRadar+", "destructoid.com": "Destructoid",
    "rockpapershotgun.com": "Rock Paper Shotgun", "polygon.com": "Polygon", "kotaku.com": "Kotaku", "pcgamesn.com": "PCGamesN",
    "thegamer.com": "TheGamer", "videogamer.com": "VideoGamer", "gamingbolt.com": "GamingBolt", "pushsquare.com": "Push Square",
    "nintendolife.com": "Nintendo Life", "purexbox.com": "Pure Xbox", "gamerant.com": "Game Rant", "dualshockers.com": "DualShockers",
    "gamesindustry.biz": "GamesIndustry.biz", "gameskinny.com": "GameSkinny", "digitaltrends.com": "Digital Trends",
    "pcinvasion.com": "PC Invasion", "godisageek.com": "GodisaGeek", "screenrant.com": "ScreenRant", "shacknews.com": "Shacknews",
    "gamewatcher.com": "GameWatcher", "rpgsite.net": "RPG Site", "hardcoregamer.com": "Hardcore Gamer", "gamespew.com": "GameSpew",
    "gamerevolution.com": "GameRevolution", "trueachievements.com": "TrueAchievements", "purenintendo.com": "Pure Nintendo",
    "metro.co.uk": "Metro GameCentral",
}

CORE_SITES = ["IGN", "GameSpot", "PC Gamer", "Wccftech", "Eurogamer", "Game Informer", "VG247", "GamesRadar+", "Destructoid"]

# --- fixed values: titles and slugs -------------------------------------------------------------

TITLE_STOPWORDS = [
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "with", "from", "by", "at", "is", "are", "was", "were", "be", "been", "being",
    "as", "this", "that", "these", "those", "new", "latest", "update", "updates",
]

SLUG_STOPWORDS = [
    "a", "an", "the", "of", "and", "or", "for", "in", "on", "at", "to", "from", "by", "with", "as", "is", "are", "was", "were", "be", "been",
    "it", "its", "this", "that", "these", "those", "has", "have", "had", "will", "just", "now", "finally", "here", "heres", "you", "your", "we",
    "our", "they", "their", "can", "could", "may", "might", "gets", "get", "reportedly", "officially", "new", "latest", "more", "than", "into",
    "about", "after", "before", "over", "up", "out", "all", "some", "very", "really",
]

LATIN_EXTRA = {"ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}

GENERIC_TAGS = [
    "game", "games", "gaming", "video game", "news", "latest news", "update", "updates", "trailer", "teaser", "dlc", "review", "preview",
    "hands on", "hardware", "technology", "tech", "pc", "console", "playstation", "xbox", "nintendo", "steam", "announcement", "release",
    "launch", "performance", "benchmark", "driver", "rumor", "rumours", "leak", "leaks",
]

# --- fixed values: content types ----------------------------------------------------------------

CONTENT_TYPES = ["gaming", "hardware", "review", "general"]

CONTENT_TYPE_ALIASES = {
    "games": "gaming", "game": "gaming", "videogame": "gaming", "tech": "hardware", "technology": "hardware", "component": "hardware", "reviews": "review",
}

REVIEW_PATTERNS = [r"\breview\b", r"\bhands[- ]on\b", r"\bpreview\b", r"\bimpressions?\b", r"\bbenchmark(?:s|ed|ing)?\b"]

HARDWARE_PATTERNS = [
    r"\bgpu\b", r"\bgraphics card\b", r"\bgeforce\b", r"\brtx\b", r"\bradeon\b", r"\bcpu\b", r"\bprocessor\b", r"\bchipset\b", r"\bchip\b", r"\bap[u]\b",
    r"\bryzen\b", r"\bcore ultra\b", r"\bintel arc\b", r"\bnvidia\b", r"\bamd\b", r"\bssd\b", r"\bram\b", r"\bddr[345]\b", r"\bmotherboard\b", r"\blaptop\b",
    r"\bmonitor\b", r"\bdisplay\b", r"\boled\b", r"\bhandheld\b", r"\bsteam deck\b", r"\brog ally\b", r"\bkeyboard\b", r"\bmouse\b", r"\bheadset\b", r"\bcontroller\b",
    r"\bdriver\b", r"\bfirmware\b", r"\bqualcomm\b", r"\bmediatek\b",
]

GAMING_PATTERNS = [
    r"\bvideo game\b", r"\bgameplay\b", r"\bgaming\b", r"\bgame\b", r"\bdlc\b", r"\bexpansion\b", r"\btrailer\b", r"\bteaser\b", r"\brelease date\b", r"\blaunch\b",
    r"\bpatch\b", r"\bmod\b", r"\bremake\b", r"\bremaster\b", r"\bearly access\b", r"\bsteam\b", r"\bepic games?\b", r"\bplaystation\b", r"\bps[45]\b", r"\bxbox\b",
    r"\bnintendo\b", r"\bswitch\b", r"\bubisoft\b", r"\bactivision\b", r"\bea\b",
]

# --- fixed values: evidence ---------------------------------------------------------------------

#: in order of priority
CATEGORY_PATTERNS = {
    "technical": [
        r"\bframe\s*rate\b", r"\bframerate\b", r"\bperformance\b", r"\boptimization\b", r"\boptimisation\b", r"\bstutter(?:ing)?\b", r"\bcrash(?:es|ing)?\b",
        r"\bbug(?:s)?\b", r"\bglitch(?:es)?\b", r"\bstability\b", r"\bstable\b", r"\bunstable\b", r"\btechnical\b", r"\bpolish\b", r"\bloading\b",
        r"\binput lag\b", r"\buser interface\b", r"\bUI\b",
    ],
    "audio": [
        r"\bvoice acting\b", r"\bvoice[- ]over(?:s)?\b", r"\bvoiceover(?:s)?\b", r"\bvocal performance(?:s)?\b", r"\bvoice cast\b", r"\bvoice direction\b",
        r"\bdubbing\b", r"\bdubbed\b", r"\bsound design\b", r"\bsound effects\b", r"\bsoundtrack\b", r"\bmusical score\b", r"\bcomposer\b",
        r"\baudio (?:design|mix|quality|presentation)\b",
    ],
    "visuals": [
        r"\bgraphics?\b", r"\bvisuals?\b", r"\bart direction\b", r"\blighting\b", r"\banimation(?:s)?\b", r"\btexture(?:s)?\b", r"\bimage quality\b",
        r"\bresolution\b", r"\bdraw distance\b", r"\bvisual presentation\b",
    ],
    "value": [
        r"\bprice\b", r"\bcost\b", r"\bvalue for money\b", r"\bgood value\b", r"\bpoor value\b",
        r"\bworth (?:the |its |your )?(?:price|cost|money|purchase|buying)\b", r"\bworth buying\b", r"\bbang for (?:your|the) buck\b", r"\bmonetization\b",
        r"\bmonetisation\b", r"\bmicrotransaction(?:s)?\b", r"\bseason pass\b", r"\breplayability\b", r"\breplay value\b", r"\bcontent[- ]to[- ]price\b",
    ],
    "world_design": [
        r"\bopen[- ]world\b", r"\benvironment(?:s)?\b", r"\blocation(?:s)?\b", r"\bmap\b", r"\bbiome(?:s)?\b", r"\bpywel\b", r"\bworld\b", r"\blandscape\b",
        r"\bregion(?:s)?\b",
    ],
    "story": [
        r"\bstory\b", r"\bnarrative\b", r"\bdialogue\b", r"\bwriting\b", r"\bplot\b", r"\blore\b", r"\bending\b", r"\bcutscene(?:s)?\b",
        r"\bcharacter development\b", r"\bcharacter(?:s)?\s+(?:arc|writing|development|dialogue)\b",
    ],
    "gameplay": [
        r"\bgameplay\b", r"\bcombat\b", r"\bbattle(?:s)?\b", r"\bboss(?:es)?\b", r"\bmechanic(?:s)?\b", r"\bsystem(?:s)?\b", r"\bcontrol(?:s)?\b",
        r"\bpuzzle(?:s)?\b", r"\bencounter(?:s)?\b", r"\bweapon(?:s)?\b", r"\bbuild(?:s)?\b", r"\bprogression\b", r"\bmovement\b", r"\bstealth\b",
        r"\bskill(?:s)?\b", r"\bactivit(?:y|ies)\b", r"\bchallenge(?:s)?\b", r"\bexplor(?:e|ation|ing)\b", r"\btravel\b", r"\btraversal\b",
    ],
}

TECHNICAL_NEGATIVE_PATTERNS = [
    r"\bdip in performance\b", r"\bperformance issue(?:s)?\b", r"\bpoor performance\b", r"\bstutter(?:ing)?\b", r"\bcrash(?:es|ing)?\b", r"\bbug(?:s)?\b",
    r"\bglitch(?:es)?\b", r"\bunstable\b", r"\black of polish\b", r"\binput lag\b", r"\bloading (?:issue|problem|time)\b",
]

TECHNICAL_POSITIVE_PATTERNS = [
    r"\bframe rate stability\b", r"\bstable frame rate\b", r"\bruns? (?:very )?well\b", r"\bsmooth(?:ly)?\b", r"\bwell optimized\b",
    r"\boptimization is (?:good|excellent)\b", r"\bbiggest triumph\b", r"\btechnically impressive\b",
]

SCORECARD_CATEGORIES = ["gameplay", "visuals", "story", "world_design", "technical", "value"]

#: terms of a claim (Persian), and the patterns one of which its quote must then match
CLAIM_DOMAINS = [
    (["نبرد", "مبارزه", "کامبت", "باس"], [r"\bcombat\b", r"\bbattle", r"\bfight", r"\bboss", r"\bweapon"]),
    (["داستان", "روایت", "شخصیت", "دیالوگ"], [r"\bstory\b", r"\bnarrative\b", r"\bplot\b", r"\bcharacter", r"\bdialogue\b", r"\bwriting\b", r"\bquest"]),
    (["عملکرد", "فنی", "فریم", "بهینه", "باگ", "کرش"], [r"\bperformance\b", r"\bframe", r"\bbug", r"\bcrash", r"\bstutter", r"\btechnical\b", r"\boptimization"]),
    (["ذخیره", "انبار", "صندوق"], [r"\bstorage\b", r"\binventory\b", r"\bchest"]),
    (["پازل"], [r"\bpuzzle\b"]),
    (["جهان باز", "محیط", "اکتشاف", "دنیا"], [r"\bopen[- ]world\b", r"\bworld\b", r"\benvironment", r"\bexplor"]),
    (["زمان بازیکن", "احترام نمی‌گذارد"], [r"\btime\b", r"\brespect"]),
]

SCORE_BLOCKED_WORDS = ["user score", "user rating", "community rating", "reader rating", "audience score", "metascore", "hours", "hour"]

GAME_STATUS_ALIASES = {
    "released": "released", "release": "released", "full release": "released", "1.0": "released", "early access": "early_access",
    "early-access": "early_access", "earlyaccess": "early_access", "ea": "early_access", "remaster": "remaster", "remastered": "remaster",
    "remake": "remake", "definitive edition": "definitive_edition", "definitive": "definitive_edition", "goty": "goty_edition",
    "goty edition": "goty_edition", "game of the year edition": "goty_edition", "dlc": "dlc", "downloadable content": "dlc",
    "expansion": "expansion", "expansion pack": "expansion", "port": "port", "console port": "port",
}

MONTHS_FA = ["ژانویه", "فوریه", "مارس", "اپریل", "می", "ژوئن", "جولای", "آگوست", "سپتامبر", "اکتبر", "نوامبر", "دسامبر"]

#: as the first generations spelled them: one differs
OLDER_MONTHS_FA = [*MONTHS_FA[:5], "جوئن", *MONTHS_FA[6:]]

COVERAGE_LABELS = ["بدون پوشش دسته‌ای", "پوشش محدود", "پوشش چندبخشی", "پوشش گسترده"]

TRUE_WORDS = ["1", "true", "yes", "on"]

# --- fixed values: facts and sections -----------------------------------------------------------

TOPIC_ORDER = ["gameplay", "world_design", "visuals", "technical", "story", "value", "audio", "general"]

TOPIC_LIMITS = {"gameplay": 6, "world_design": 6, "visuals": 4, "story": 5, "technical": 4, "value": 3, "audio": 3, "general": 2}

GENERIC_MARKERS = ["تجربه‌ای جذاب", "تجربه جذاب", "شگفت‌انگیز", "ارزش تجربه", "ارزش بازی کردن", "غیرقابل ترک", "بسیار سرگرم‌کننده"]

SPECIFIC_MARKERS = [
    "جهان", "اکتشاف", "کاوش", "تعامل", "مبارز", "نبرد", "باس", "رئیس", "پازل", "سیستم", "مکانیک", "کنترل", "اسب", "داستان", "روایت", "شخصیت",
    "نوشتار", "ترجمه", "ماموریت", "عملکرد", "فنی", "باگ", "موجودی", "ذخیره", "زمان", "طراحی", "پیشرفت", "گرافیک", "نورپردازی", "انیمیشن", "بافت",
    "صداگذاری", "موسیقی", "قیمت", "محتوا", "ارزش خرید", "تکرارپذیری",
]

#: topics of a claim that its quote does not settle, in order
TOPIC_TERMS = {
    "world_design": ["جهان", "اکتشاف", "کاوش", "محیط", "تعامل"],
    "gameplay": ["مبارز", "نبرد", "باس", "رئیس", "پازل", "کنترل", "اسب", "مکانیک", "سیستم"],
    "story": ["داستان", "روایت", "شخصیت", "نوشتار", "ترجمه", "ماموریت"],
    "technical": ["عملکرد", "فنی", "باگ", "کرش", "بهینه"],
}

FORBIDDEN_WORDS = [
    "پوشش شواهد", "شواهد تأییدشده", "پرونده‌ی فعلی", "پرونده فعلی", "سطح اطمینان", "برداشت اولیه", "به‌صورت خودکار", "منبع بررسی‌شده",
    "منابع بررسی‌شده", "نقدهای انتخاب‌شده", "مدل زبانی", "هوش مصنوعی", "evidence", "confidence", "متاکریتیک", "امتیاز", "نمره",
    "منتقد", "سایت", "وب‌سایت", "منبع",
]

TRAILER_WORDS = ["وفاداری", "قهرمانان شکل", "سرزمین‌های سخت", "خطرات ناشناخته", "به دنیای بازی", "وارد دنیای"]

# --- fixed values of scores on pages: labels, keys and scales ---

VISIBLE_SCORE = r"\b(?:review\s*score|final\s*score|rating|verdict)\b[^0-9]{0,50}(\d{1,3}(?:\.\d+)?)\s*(?:/|out\s+of)\s*(10|5|100)\b"
ELEMENT_SCORE = r"""<(?:span|div|p)[^>]+(?:class|data-testid)=["'][^"']*(?:review[-_ ]?score|rating|score)[^"']*["'][^>]*>\s*(\d{1,3}(?:\.\d+)?)\s*(?:/|out\s+of)\s*(10|5|100)\b"""
HEADER_SCORES = [r"\bGaming\s+(?:Score\s*)?(\d{1,2}(?:\.\d+)?)\b", r"\bScore\s*:?\s*(\d{1,2}(?:\.\d+)?)\b.{0,120}?\bGaming\b"]
HEADER_SCORE_HOST = "wccftech.com"
SCORE_META_KEYS = ["review:rating", "review_rating", "reviewrating", "ratingvalue"]
SCALE_ATTRIBUTES = ["best-rating", "bestrating", "rating-scale", "scale"]

# --- fixed values of article checks ---

#: adjectives that praise without telling anything
PROSE_ADJECTIVES = [
    "غنی", "پرجزئیات", "زیبا", "خیره‌کننده", "شگفت‌انگیز", "عالی", "فوق‌العاده",
    "گیرا", "پویا", "چشم‌نواز", "نفس‌گیر", "دلنشین", "لذت‌بخش", "بی‌نظیر",
    "استثنایی", "خارق‌العاده", "تحسین‌برانگیز", "درخشان", "بی‌نقص", "جذاب",
    "دوگانه", "ماندگار", "فراموش‌نشدنی", "منحصربه‌فرد", "چشمگیر", "افسانه‌ای",
    "رویایی", "سرشار", "پربار", "کامل", "بی‌عیب",
]

#: details that make a sentence concrete
PROSE_DETAILS = [
    "اکتشاف", "کاوش", "تعامل", "مبارز", "نبرد", "باس", "رئیس", "پازل",
    "سیستم", "مکانیک", "کنترل", "اسب", "نوشتار", "ترجمه", "ماموریت",
    "عملکرد", "فنی", "باگ", "موجودی", "ذخیره", "پیشرفت",
]

PROSE_NEGATIONS = ["نه ", "نه‌فقط", "نه‌تنها", " نیست", "به‌جای", "بدون ", "فاقد "]

#: phrases that a part of an article must not have
PART_PHRASES = {
    "opening": ["داستانی جذاب", "شخصیت‌های جذاب", "تجربه‌ای دوگانه", "وعده‌های بزرگ"],
    "world_gameplay": [
        "سیستم‌های بازی به طور نامشخص", "سیستم‌های بازی نامشخص",
        "سیستم‌های ناسازگار", "به سمت حدس زدن", "باعث سردرگمی",
        "نبردهای رئیس", "سیستم موجودی", "سینه‌های ذخیره‌سازی",
        "سرعت پیشرفت", "کند کردن پیشرفت",
    ],
    "audience": ["کمی صبر کنید", "بهتر است صبر کنید", "صبر کنید یا", "بعداً بخرید", "بعدا بخرید"],
    "conclusion": ["نیاز به بهبود", "بازیکنان را رها می‌کند", "جستجوی یک تجربه بهتر"],
}

EMPTY_PHRASES = ["به طرز شگفت‌انگیزی", "از هر گوشه", "ساعت‌ها در این دنیا", "تجربه‌ای دوگانه", "مشکلات جدی"]

#: parts whose every sentence must be backed
FACTUAL_PARTS = ["opening", "world_gameplay", "friction"]

#: least and most words of each part, of the single-pass and of the long-form article
SINGLE_PASS_BOUNDS = {"opening": (24, 220), "world_gameplay": (55, 420), "friction": (55, 420), "audience": (24, 220), "conclusion": (24, 220)}
LONG_FORM_BOUNDS = {"opening": (75, 180), "world_gameplay": (190, 380), "friction": (180, 370), "audience": (65, 155), "conclusion": (75, 170)}

QUALITY_ACTIONS = {
    "manual_supported": "پوشش منبع با شاهدهای بررسی‌شده‌ی دستی تکمیل شده است",
    "manual_review": "بازبینی دستی لازم است",
    "needs_review": "بازخوانی انتخابی توصیه می‌شود",
    "acceptable": "برای استفاده‌ی پایدار قابل‌قبول است",
}

#: keywords of the second generation's categories, the first group that is found wins
KEYWORD_CATEGORIES = {
    "review": ["review", "hands-on", "preview", "impressions", "benchmark"],
    "hardware": ["gpu", "rtx", "radeon", "cpu", "intel", "amd", "nvidia", "laptop", "ssd", "ram", "motherboard", "dlss", "fsr"],
    "gaming": ["game", "gaming", "steam", "ps5", "xbox", "nintendo", "dlc", "trailer"],
}

# --- fixed values of the article that rules write ---

SCORECARD_LABELS = {
    "gameplay": "گیم‌پلی",
    "visuals": "گرافیک و طراحی هنری",
    "story": "داستان و شخصیت‌پردازی",
    "world_design": "طراحی جهان و اکتشاف",
    "technical": "عملکرد فنی",
    "value": "ارزش خرید و محتوا",
}

#: sentences around the labels of categories with a trend
TREND_SENTENCES = {
    "positive": ("در پرونده‌ی فعلی، ارزیابی منابع نسبت به ", " مثبت‌تر است."),
    "negative": ("نکات احتیاطی ثبت‌شده بیشتر به ", " مربوط می‌شوند."),
    "other": ("برای ", " شواهد موجود تصویر ترکیبی یا خنثی نشان می‌دهند."),
}

AUDIENCE_SENTENCES = {
    "positive": (" بیشتر به بازیکنانی پیشنهاد می‌شود که برای ", " در یک بازی اهمیت زیادی قائل‌اند، چون ارزیابی منابع بررسی‌شده در این زمینه‌ها مثبت‌تر بوده است."),
    "negative": ("در مقابل، اگر ", " اولویت اصلی شما برای خرید است، بهتر است پیش از خرید نقدهای کامل منابع را هم بررسی کنید، چون شواهد این پرونده در این زمینه‌ها نکات احتیاطی ثبت کرده‌اند."),
    "none": ("شواهد ثبت‌شده درباره‌ی ", " در این پرونده ترکیبی است و در حال حاضر برای هیچ‌کدام از بخش‌ها جهت‌گیری قاطع مثبت یا منفی گزارش نشده است."),
}

SPREAD_SENTENCES = (
    "فاصله‌ی نمره‌ی منابع بررسی‌شده در این پرونده حدود ", " از ۱۰ است؛ یعنی دیدگاه منتقدان درباره‌ی این بازی یکدست نیست.",
    "نمره‌ی منابع بررسی‌شده در این پرونده به هم نزدیک است و اختلاف چشمگیری در امتیازدهی دیده نمی‌شود.",
)

NO_HIGHLIGHT = "نکته‌ی متمایزکننده‌ی قابل‌استناد در این منبع ثبت نشده است."
NO_SCORE = "بدون نمره‌ی قابل‌تشخیص"
