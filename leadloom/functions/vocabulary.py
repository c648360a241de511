# -*- coding: utf-8 -*-
"""Term lists, host lists and e-mail rules the results depend on.

Everything in this module is a plain value. Every job takes these as parameters, so a user can
replace any list. Entries keep their natural order, because some rules take the first hit.
"""


# ---------------------------------------------------------------- fixed values: hosts

BLOCKED_HOSTS = (
    "facebook.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com", "amazon.com", "wikipedia.org",
    "pinterest.com", "x.com", "twitter.com", "tradekey.com", "alibaba.com", "globalsources.com", "petsglobal.com",
    "pagefly.io", "cosmeticsbusiness.com", "procureradar.com", "brainly.com", "indiamart.com", "tradeindia.com",
    "exporthub.com", "go4worldbusiness.com", "scribd.com", "slideshare.net", "issuu.com", "yumpu.com", "academia.edu",
    "researchgate.net", "medium.com", "blogspot.com", "wordpress.com", "tradeholding.com", "chinatradeholding.com",
    "indotrading.com", "globalcosmeticsnews.com", "careerlink.vn", "careerviet.vn", "huggingface.co", "kaggle.com",
    "github.com", "gitlab.com", "d7leadfinder.com", "expolume.com", "sourceready.com", "asiapro-distribution.com",
    "vietdata.vn", "mekongcapital.com", "dewsia.com", "sblaw.vn", "lawyer24h.net", "hptoancau.com", "meiyume.com",
    "trueen.com", "zipleaf.us", "eventseye.com", "tradeimex.in", "vietnambusinessgateway.com", "consultingroom.com",
    "trade.gov", "whatclinic.com", "yellowpages.com.vn", "ensun.io", "studocu.vn", "b2btradeshows.net",
    "topfranchise.com", "ec21.com", "marketinsidedata.com", "bestfoodimporters.com", "turkishexporter.com.tr",
    "vietnamia.org", "europages.co.uk", "volza.com", "cosmeticindex.com", "b2bmap.com", "market.us",
    "themeforest.net", "templatemonster.com", "pro.makeup", "pinterest.ca", "pinterest.at", "statista.com",
    "researchandmarkets.com", "expertmarketresearch.com", "goldsupplier.com", "everychina.com", "brandcrowd.com",
    "rocketreach.co", "informamarkets-info.com", "bizhwy.com", "personalcare1.com", "vietnam.travel",
    "sunshine-events.co.il", "listcompany.org", "tradewheel.com", "secomm.vn", "globaltradeplaza.com",
    "trangvangvietnam.com", "ecomeye.com", "silverlandhotels.com", "banchaidanhrangnano.com", "yelp.com", "dnb.com",
    "lemon8-app.com", "classpass.com", "companydata.com", "abraa.com", "inaexport.id", "manufacturers.com.tw",
    "quora.com", "listofcompaniesin.com",
)

MEDIA_HOSTS = (
    "vietcetera.com", "vietnamnet.vn", "vietnamnews.vn", "vtv.vn", "cafef.vn", "nguoiduatin.vn",
    "thuonghieucongluan.com.vn", "the-shiv.com", "kenh14.vn",
)

DIRECTORY_HOSTS = (
    "infoisinfo-ca.com", "infoisinfo.com", "listcompany.org", "tradewheel.com", "timnhaphanphoi.vn", "top10tphcm.com",
)

BRAND_OWNER_HOSTS = ("loreal.com", "laboratoriosbabe.com.vn", "moicosmetics.vn")
BRAND_OWNER_NAMES = ("l'oréal", "laboratorios babé", "m.o.i cosmetics")

# Two-part public suffixes under which a company registers its name.
TWO_PART_SUFFIXES = (
    "com.vn", "co.uk", "com.au", "co.jp", "com.sg", "com.my", "co.id", "co.th", "com.ph", "com.tr", "co.il",
)

COUNTRY_TLDS = (
    "vn", "jp", "th", "id", "tw", "de", "fr", "mx", "ae", "au", "uk", "sg", "my", "ph", "tr", "il", "us", "ca", "cn",
    "in", "kr",
)

# Last labels that are no top-level domain: names kept for local use, endings of web files.
NO_TLDS = (
    "local", "localhost", "localdomain", "internal", "intranet", "lan", "corp", "home", "invalid", "test", "example", "onion",
    "js", "mjs", "jsx", "ts", "tsx", "css", "scss", "less", "map", "json", "xml", "html", "htm", "xhtml", "php", "asp", "aspx",
    "jsp", "png", "jpg", "jpeg", "gif", "svg", "webp", "avif", "ico", "bmp", "tif", "tiff", "woff", "ttf", "otf", "eot", "pdf",
    "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv", "txt", "webm", "ogg", "wav", "avi", "exe", "dll", "bin", "min", "bundle",
)

FREE_MAIL_HOSTS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com")
PLACEHOLDER_MAIL_HOSTS = ("addresshere.com", "example.com", "example.org", "example.net", "yourdomain.com")

# Company names that are fixed for one first label of the registrable domain.
DOMAIN_NAMES = {
    "kolmarvietnam": "Kolmar Vietnam",
    "kprivatelabel": "KPrivateLabel",
    "eliintl": "ELI INTERNATIONAL",
    "peroma": "Peroma",
}

# ---------------------------------------------------------------- fixed values: e-mail rules

BLOCKED_EMAIL_PARTS = (
    "example.com", "sentry.io", "wixpress.com", "cloudflare.com", "email.com", "domain.com", "messages.contact",
    ".png", ".jpg", ".jpeg", ".svg", ".webp", ".gif",
)
AUTOREPLY_LOCALS = ("noreply", "no-reply", "donotreply", "do-not-reply")

# Local-part token -> purpose; the first token contained in the local part wins.
EMAIL_PURPOSES = (
    ("recruitment", "recruiting"),
    ("recruit", "recruiting"),
    ("career", "recruiting"),
    ("hiring", "recruiting"),
    ("jobs", "recruiting"),
    ("hr", "recruiting"),
    ("tuyendung", "recruiting"),
    ("nhansu", "recruiting"),
    ("vieclam", "recruiting"),
    ("toasoan", "press"),
    ("sales", "b2b_sales"),
    ("business", "b2b_partnership"),
    ("partner", "b2b_partnership"),
    ("partnership", "b2b_partnership"),
    ("vendor", "b2b_purchasing"),
    ("purchase", "b2b_purchasing"),
    ("procurement", "b2b_purchasing"),
    ("export", "b2b_sales"),
    ("info", "general"),
    ("contact", "general"),
    ("hello", "general"),
    ("admin", "general"),
    ("support", "customer_service"),
    ("cskh", "customer_service"),
    ("care", "customer_service"),
    ("leasing", "leasing"),
    ("lease", "leasing"),
    ("cho-thue", "leasing"),
    ("chothue", "leasing"),
    ("privacy", "legal"),
    ("legal", "legal"),
    ("abuse", "legal"),
)
SALES_LOCAL_TOKENS = (
    "export", "oversea", "international", "foreign", "global", "partner", "partnership", "business", "bd", "sales",
)

# Path tokens that rank where an address was published; the first group that matches wins.
PARTNER_PATHS = (
    "partner", "partnership", "cooperation", "business", "export", "international", "oversea", "vendor", "supplier",
    "doi-tac", "hop-tac",
)
CONTACT_PATHS = (
    "contact", "contact-us", "lien-he", "lienhe", "kontakt", "contato", "contacto", "contacts", "reach-us", "support",
    "customer-service",
)
ABOUT_PATHS = ("about", "company", "gioi-thieu")
ARTICLE_PATHS = ("news", "blog", "article", "academy", "course", "report")
CONTACT_LINK_HINTS = (
    "contact", "about", "team", "company", "sales", "import", "purchase", "partner", "vendor", "supplier", "lien-he",
    "gioi-thieu", "hop-tac",
)
USUAL_CONTACT_PATHS = (
    "contact", "contact-us", "contacts", "lien-he", "lien-he/", "lienhe", "hoi-dap/lien-he", "pages/contact",
    "pages/lien-he", "gioi-thieu/lien-he", "support", "customer-service",
)

# ---------------------------------------------------------------- fixed values: search-result terms

BUYER_TERMS = (
    "importer", "import and distribution", "import & distribution", "exclusive distributor", "distributor",
    "distribution company", "wholesaler", "wholesale", "retail chain", "retailer", "buyer", "procurement",
    "nhà nhập khẩu", "nhap khau", "phân phối", "phan phoi", "bán buôn", "ban buon", "bán lẻ", "ban le",
    "aesthetic clinic", "beauty clinic", "dermatology clinic", "beauty salon", "professional salon", "spa",
    "thẩm mỹ viện", "phòng khám da liễu", "spa làm đẹp", "salon làm đẹp",
)
STRONG_BUYER_TERMS = (
    "importer", "exclusive distributor", "authorized distributor", "wholesaler", "wholesale distributor",
    "retail chain", "distribution company", "nhà nhập khẩu", "nhà phân phối", "bán buôn", "bán lẻ",
)
CONTENT_TERMS = (
    "news", "magazine", "academy", "university", "training course", "blog", "document library", "market report",
    "industry report", "price list", "review article", "tin tức", "học viện", "đào tạo",
)
NON_COMPANY_TITLE_TERMS = (
    "job", "jobs", "career", "recruitment", "hiring", "directory", "marketplace", "buying leads", "market report",
    "industry report", "news", "academy", "training", "verifying", "cookie required", "tuyển dụng", "việc làm",
    "danh bạ", "tin tức",
)
NON_COMPANY_PATHS = (
    "/job/", "/jobs/", "/career/", "/careers/", "/recruitment/", "/news/", "/blog/", "/article/", "/directory",
    "/buying-lead", "/market-report", "/industry-report",
)
QUERY_EXCLUSIONS = (
    "jobs", "job", "career", "recruitment", "news", "directory", "marketplace", "buying leads", "lead platform",
    "yelp", "lemon8", "d&b",
)
ECOSYSTEM_TERMS = (
    "exhibitor", "exhibitors", "exhibition", "expo", "trade fair", "member directory", "member companies",
    "association", "show directory", "danh sách doanh nghiệp", "hiệp hội",
)
ECOSYSTEM_PATHS = ("exhibitor", "member", "directory", "association", "expo")
ECOSYSTEM_TITLES = ("exhibitor", "exhibition", "expo", "association", "member directory")
SKIPPED_LINK_LABELS = ("privacy", "terms", "ticket", "register", "login", "media partner", "powered by")

INDUSTRY_TERMS = {
    "cosmetics": (
        "cosmetic", "cosmetics", "skincare", "skin care", "beauty", "makeup", "personal care", "nail", "nail care",
        "nailbox", "manicure", "gel polish", "móng", "chăm sóc móng", "mỹ phẩm", "my pham", "chăm sóc da",
    ),
    "beauty": (
        "beauty", "cosmetic", "cosmetics", "skincare", "skin care", "makeup", "hair care", "personal care", "nail",
        "nail care", "nailbox", "manicure", "gel polish", "móng", "chăm sóc móng", "mỹ phẩm", "làm đẹp",
    ),
    "food": ("food", "foods", "beverage", "grocery", "groceries", "snack", "processed food", "thực phẩm", "đồ uống"),
    "health_food": (
        "health food", "supplement", "nutraceutical", "functional food", "vitamin", "dietary", "thực phẩm chức năng",
    ),
    "medical": (
        "medical device", "medical equipment", "diagnostic", "healthcare equipment", "hospital equipment",
        "thiết bị y tế",
    ),
    "household": (
        "household", "home care", "consumer goods", "daily necessities", "cleaning product", "personal care",
        "hàng tiêu dùng",
    ),
}
GENERIC_PRODUCT_WORDS = (
    "product", "products", "personal", "care", "professional", "premium", "korean", "goods", "item", "items",
    "company", "brand", "brands",
)
BEAUTY_INDUSTRIES = ("cosmetics", "beauty")

# ---------------------------------------------------------------- fixed values: page evidence terms

PLATFORM_TERMS = (
    "buying leads directory", "b2b sourcing platform", "global buyer leads", "marketplace", "submit your requirement",
    "signing up", "select industry", "quote now", "software platform", "news and analysis", "trade publication",
    "lead finder", "find business leads", "ai-powered sourcing platform", "find suppliers", "supplier database",
    "search for leads", "verified leads", "company database", "export leads", "sales intelligence", "buying demand",
    "selling demand", "business opportunity", "all projects", "project listing", "post a project",
    "investment projects", "buyer request board", "seller request board", "add new company listing",
    "free company listing", "list of companies",
)
DIRECTORY_IDENTITY_TERMS = (
    "business directory", "list your business", "claim your listing", "danh bạ doanh nghiệp",
    "đăng tin tìm nhà phân phối", "kết nối nhà cung cấp và nhà phân phối",
)
LISTING_ACTION_TERMS = ("tin rao vặt", "báo giá đăng tin", "báo giá banner", "đăng tin tìm đại lý")
AGENT_SEARCH_TERMS = ("tìm đại lý", "tìm nhà cung cấp", "nhận làm đại lý")
PACKAGING_TERMS = (
    "cosmetic packaging", "beauty packaging", "packaging supplier", "packaging manufacturer", "bao bì mỹ phẩm",
    "chai lọ mỹ phẩm", "bottle packaging", "container packaging",
)
MANUFACTURER_TERMS = (
    "we manufacture", "our factory", "manufacturing facility", "production plant", "production factory",
    "we are a manufacturer", "manufacturer of", "manufacturer", "we produce", "producer of", "contract manufacturer",
    "oem manufacturer", "odm manufacturer", "oem/odm", "private label manufacturer", "nhà máy sản xuất",
    "cơ sở sản xuất", "gia công mỹ phẩm", "sản xuất mỹ phẩm", "nhà sản xuất", "xưởng sản xuất",
    "trực tiếp thiết kế và chế tạo", "thiết kế và chế tạo", "tự chủ hoàn toàn khâu thiết kế",
    "gia công và tự động hóa", "năng lực gia công cơ khí",
)
MANUFACTURER_NAME_TERMS = ("factory", "manufacturer", "manufacturing", "nhà máy", "sản xuất")
OWN_FACTORY_TERMS = (
    "our factory", "we manufacture", "we are a manufacturer", "manufacturing facility", "production factory",
    "manufacturer of", "manufacturer and distributor", "oem/odm", "oem manufacturer", "odm manufacturer",
    "nhà máy sản xuất", "nhà sản xuất và", "xưởng sản xuất oem", "xưởng sản xuất odm", "cơ sở sản xuất của chúng tôi",
    "trực tiếp thiết kế và chế tạo", "thiết kế và chế tạo", "tự chủ hoàn toàn khâu thiết kế",
    "gia công và tự động hóa", "năng lực gia công cơ khí",
)
CONTRACT_MAKER_TERMS = ("private label", "contract manufacturing", "oem", "odm")
NOT_DISTRIBUTOR_TERMS = (
    "không phải đơn vị phân phối", "không phải nhà phân phối", "not a distributor", "we are not a distributor",
)
GENERIC_DISTRIBUTION_TERMS = (
    "distributor", "distribution company", "nhà phân phối", "phân phối", "phan phoi", "hệ thống phân phối",
    "he thong phan phoi", "đại lý", "dai ly",
)
MAKER_IGNORED_ROLE_TERMS = (
    "phân phối", "phan phoi", "nhà phân phối", "distributor", "nhập khẩu chính hãng", "officially imported",
)
SUPPLIER_TERMS = (
    "chuyên cung cấp", "nhà cung cấp", "cung cấp các loại", "cung cấp máy", "officially imported",
    "authorized supplier", "industrial equipment supplier",
)
BUYER_IDENTITY_TERMS = (
    "importer", "distributor", "wholesale", "we import", "imports and distributes", "import and distribute",
    "import and distribution", "importing and distributing", "specializing in the import", "exclusive distributor",
    "authorized distributor", "distribution company", "wholesale distributor", "wholesaler", "retail chain",
    "wholesale supplier", "beauty supplier", "cosmetics supplier", "aesthetic clinic", "beauty clinic",
    "dermatology clinic", "beauty salon", "professional salon", "nhà nhập khẩu", "nhap khau",
    "nhập khẩu và phân phối", "nhap khau va phan phoi", "nhà phân phối", "phân phối", "phan phoi",
    "cung ứng và phân phối", "cung ung va phan phoi", "hệ thống phân phối", "he thong phan phoi",
    "phân phối độc quyền", "đại lý", "dai ly", "bán buôn", "bán lẻ", "skin clinic", "cosmetic clinic", "medical spa",
    "beauty spa", "thẩm mỹ viện", "thẩm mỹ", "phòng khám", "phong kham", "phòng khám da liễu", "spa làm đẹp",
    "salon làm đẹp", "cửa hàng mỹ phẩm", "cửa hàng phân phối", "hệ thống cửa hàng", "tìm cửa hàng",
)
EXTRA_IMPORT_TERMS = ("nhập khẩu chính hãng", "xuất nhập khẩu", "xuat nhap khau")
INVESTMENT_TERMS = (
    "private equity", "venture capital", "investment firm", "investment fund", "growth capital",
    "portfolio companies", "portfolio by sectors", "investment criteria", "asset management",
)
INVESTMENT_NAME_TERMS = ("capital", "investment", "ventures", "private equity")
LEGAL_TERMS = (
    "law firm", "lawyers", "legal services", "legal consulting", "law office", "trademark registration",
    "dispute resolution", "employment law", "intellectual property law",
)
LEGAL_NAME_TERMS = ("law", "lawyer", "legal", "attorney")
LOGISTICS_TERMS = (
    "logistics company", "logistics service", "international shipping", "freight forwarding", "freight service",
    "customs service", "customs broker", "customs brokerage", "customs declaration", "cargo transportation",
    "import procedure service", "shipping service", "fulfillment", "warehouse management", "warehousing",
    "last-mile delivery", "last mile delivery", "order processing",
)
EXPLICIT_LOGISTICS_TERMS = (
    "logistics company", "logistics service", "freight forwarding", "customs service", "customs broker",
    "customs declaration", "international shipping", "trucking",
)
RECORD_IMPORTER_TERMS = ("importer of record", "exporter of record", "customs clearance")
FULFILLMENT_TERMS = (
    "fulfillment", "warehouse management", "order processing", "last-mile delivery", "last mile delivery",
)
STRONG_MEDIA_TERMS = (
    "market research", "industry research", "company research", "economic data", "macro database",
    "editorial platform", "editorials & analysis", "news editorials", "consumer guides", "industry publication",
    "media platform", "magazine", "e-magazine", "newspaper", "news portal", "báo điện tử", "tạp chí điện tử",
    "bao dien tu", "tap chi dien tu", "thời báo", "thoi bao", "tạp chí", "tap chi", "đài truyền hình",
    "dai truyen hinh", "cơ quan trung ương", "co quan trung uong", "tòa soạn", "toa soan", "ban biên tập",
    "ban bien tap", "phóng viên", "phong vien", "news & review", "news and review", "digital cover",
    "subscribe to the newsletter",
)
WEAK_MEDIA_TERMS = ("brand news", "product reviews", "news", "academy", "blog")
MEDIA_IDENTITY_TERMS = (
    "tạp chí điện tử", "tap chi dien tu", "báo điện tử", "bao dien tu", "news portal", "newspaper",
    "editorial platform", "cơ quan trung ương", "co quan trung uong",
)
EXHIBITION_TERMS = (
    "international trade exhibition", "trade exhibition", "triển lãm thương mại", "trien lam thuong mai",
    "triển lãm quốc tế", "trien lam quoc te", "hội chợ thương mại", "hoi cho thuong mai",
)
EXHIBITION_NAME_TERMS = ("association", "exhibition", "expo", "trade fair", "hiệp hội")
EXHIBITION_PATH_SEGMENTS = ("exhibitor", "member-directory", "association", "expo")
FAIR_NAME_PATTERNS = (
    "trade fair", "industrial.*fair", "manufacturing fair", "exhibition organizer", "exhibition centre",
)
FAIR_NAVIGATION_TERMS = ("book a stand", "for exhibitors", "exhibitor registration", "hosted buyer program")
AGENCY_TERMS = (
    "company registration", "market entry service", "business consulting", "business advisory", "licensing service",
    "regulatory consulting", "consulting service", "incorporation & compliance", "business setup",
    "corporate amendments", "product registration service",
)
EQUIPMENT_TERMS = (
    "medical equipment", "aesthetic equipment", "ophthalmic equipment", "beauty equipment", "medical device",
    "aesthetic device", "laser equipment", "surgical equipment",
)
SOFTWARE_TERMS = (
    "spa and salon software", "salon software", "clinic software", "booking software", "appointment software",
    "point of sale software", "pos software", "business management software", "sales management software",
    "omnichannel management", "ecommerce software", "e-commerce software", "phần mềm quản lý bán hàng",
    "phần mềm bán hàng", "phần mềm quản lý", "nhanh.pos", "nhanh.ship",
)
SOFTWARE_NAME_WORDS = ("software", "soft", "saas", "cloud", "pos")
SOFTWARE_NAME_TERMS = ("phần mềm", "phan mem")
SOFTWARE_CONTEXT_TERMS = ("phần mềm dms", "phan mem dms", "giải pháp phần mềm", "tích hợp erp")
SOFTWARE_FEATURE_TERMS = ("quản lý khách hàng", "quản lý đơn hàng", "ứng dụng di động", "dms ai", "saas")
SERVICE_IDENTITIES = {
    "clinical_research": (
        "contract research organization", "clinical trials cro", "clinical research organization", "clinical trials",
        "feasibility assessments", "ba/be studies",
    ),
    "software": (
        "shoppable media", "where to buy tools", "commerce intelligence", "commerce orchestration",
        "commerce enablement platform", "commerce enable commerce everywhere",
    ),
    "outsourcing": (
        "live answering service", "virtual receptionist", "salon outsourcing", "medspa outsourcing",
        "virtual salesforce", "call center services",
    ),
}
CLEANROOM_TERMS = ("cleanroom", "clean room", "thiết bị phòng sạch", "thi công phòng sạch")
STRONG_CLEANROOM_TERMS = (
    "cleanroom equipment", "cleanroom construction", "thiết bị phòng sạch", "thi công phòng sạch",
)
TOURISM_TERMS = (
    "official tourism website", "tourism authority", "tourism board", "tourism office", "national tourism",
    "travel guide", "tourist information", "visit vietnam",
)
TOURISM_NAME_TERMS = ("tourism", "tourist", "travel guide", "travel", "tours")
SPAM_TERMS = (
    "online casino", "casino games", "sports betting", "sportsbook", "slot games", "slot88", "topslot",
    "betting site", "jackpot",
)
OWN_STORE_TERMS = (
    "shopping cart", "add to cart", "flash sale", "free shipping", "retail price", "shop now", "giỏ hàng", "mua hàng",
    "mua online", "đặt hàng", "ưu đãi", "cửa hàng", "tìm cửa hàng", "miễn phí giao hàng", "sản phẩm yêu thích",
)
MULTIBRAND_TERMS = (
    "multi-brand", "multibrand", "shop by brand", "brands we carry", "authorized retailer", "authorized dealer",
    "official retailer", "official dealer", "genuine cosmetics", "mỹ phẩm chính hãng", "hàng chính hãng",
    "đại lý chính hãng", "giấy chứng nhận đại lý", "các thương hiệu", "nhiều thương hiệu", "chuỗi cửa hàng",
    "hệ thống cửa hàng",
)
DEALER_PATHS = ("giay-chung-nhan-dai-ly", "authorized-dealer", "authorized-retailer")
OWN_BRAND_TERMS = (
    "our brand", "our own brand", "our products are", "brand story", "official brand website",
    "câu chuyện thương hiệu", "thương hiệu của chúng tôi", "sản phẩm của chúng tôi",
)
BRAND_OWNER_TERMS = (
    "our brands", "brand portfolio", "brand owner", "global brands", "house of brands", "investors & shareholders",
    "investors and shareholders", "annual report", "corporate governance", "groupe", "our purpose",
    "research & innovation", "research and innovation",
)
STRONG_DISTRIBUTION_TERMS = (
    "importer", "we import", "imports and distributes", "exclusive distributor", "authorized distributor",
    "distribution company", "wholesale distributor", "nhà nhập khẩu", "nhập khẩu và phân phối", "nhà phân phối",
    "phân phối độc quyền", "hệ thống phân phối", "nhập khẩu chính hãng", "xuất nhập khẩu", "xuat nhap khau",
    "chuyên cung cấp", "nhà cung cấp", "cung cấp các loại", "cung cấp máy",
)
EXPORT_SELLER_TERMS = (
    "wholesale exporter", "source for importers", "destination for importers", "we export", "export products",
    "exporting products", "oversea clients", "overseas clients", "products from vietnam", "source goods from vietnam",
    "export partner", "export supplier", "supplier for importers", "for overseas buyers", "serving overseas buyers",
    "products from thailand", "products from indonesia", "products from japan", "products from taiwan",
    "products from germany", "products from france", "products from mexico", "products from uae", "made in thailand",
    "made in indonesia", "made in japan", "made in taiwan", "made in mexico", "exportación", "exportacion",
    "exportateur", "exporteur", "exporter of",
)
IMPORT_NAME_TERMS = ("importer", "nhà nhập khẩu", "xuất nhập khẩu", "xuat nhap khau", "xnk")
INBOUND_IMPORT_TERMS = (
    "importer", "imported brands", "we import", "imports and distributes", "import and distribute",
    "importing and distributing", "specializing in the import", "our import products", "nhà nhập khẩu",
    "công ty nhập khẩu", "nhập khẩu chính hãng", "nhập khẩu và phân phối", "nhap khau va phan phoi",
    "máy được nhập khẩu chính hãng", "các máy kiểm tra được nhập khẩu", "xnk",
)
OWN_IMPORT_TERMS = (
    "we import", "imports and distributes", "import and distribute", "importing and distributing",
    "specializing in the import", "nhà nhập khẩu", "công ty nhập khẩu", "nhập khẩu và phân phối",
    "nhap khau va phan phoi",
)
COSMETIC_PRODUCT_TERMS = ("cosmetics", "skincare", "skin care", "makeup", "personal care", "mỹ phẩm", "chăm sóc da")
CLINIC_TRADE_TERMS = (
    "products we use", "professional products", "purchasing and using", "purchase professional", "product portfolio",
    "product range", "shop products", "retail products", "authorized retailer", "stockist", "brand distributor",
    "distributes brands", "cửa hàng mỹ phẩm", "sản phẩm phân phối", "phân phối mỹ phẩm", "đại lý mỹ phẩm",
    "bán lẻ mỹ phẩm",
)
GARMENT_TERMS = (
    "garment factory", "clothing factory", "sewing factory", "apparel manufacturer", "cut & sew", "ready-to-wear",
    "women's wear", "womenswear", "knit fabric", "garments we produce", "ppe", "n95", "ffp2", "surgical mask",
    "disposable mask", "respirator",
)
MASK_WORDS = ("mask", "masks", "facial mask", "facial masks")

# Buyer type by text, first type with a hit wins; a clinic word in the company name wins over all.
CLINIC_NAME_TERMS = ("clinic", "spa", "salon", "thẩm mỹ viện", "tham my vien", "phòng khám", "phong kham")
BUYER_TYPE_TERMS = {
    "importer": (
        "importer", "we import", "imports and distributes", "nhà nhập khẩu", "nhập khẩu", "nhập khẩu chính hãng",
        "xuất nhập khẩu", "xuat nhap khau", "nhập khẩu và phân phối",
    ),
    "distributor": (
        "exclusive distributor", "authorized distributor", "distribution company", "distributor", "nhà phân phối",
        "phân phối", "phan phoi", "cung ứng và phân phối", "hệ thống phân phối", "phân phối độc quyền", "đại lý",
        "chuyên cung cấp", "nhà cung cấp", "cung cấp các loại", "cung cấp máy", "officially imported",
        "authorized supplier", "industrial equipment supplier",
    ),
    "wholesaler": ("wholesaler", "wholesale distributor", "wholesale", "bán buôn"),
    "retail_chain": (
        "retail chain", "retailer", "bán lẻ", "cửa hàng mỹ phẩm", "cửa hàng phân phối", "hệ thống cửa hàng",
        "tìm cửa hàng",
    ),
    "clinic_salon": (
        "aesthetic clinic", "beauty clinic", "dermatology clinic", "skin clinic", "cosmetic clinic", "beauty salon",
        "professional salon", "medical spa", "beauty spa", "thẩm mỹ viện", "thẩm mỹ", "phòng khám", "phong kham",
    ),
}

# ---------------------------------------------------------------- fixed values: country evidence

LOCATION_HINTS = (
    "address", "head office", "headquarters", "registered office", "located", "based in", "office in", "địa chỉ",
    "dia chi", "trụ sở", "tru so",
)
PRESENCE_TERMS = ("contact", "hotline", "store", "stores", "branch", "branches", "cửa hàng", "hệ thống")
LOCAL_BUSINESS_TERMS = (
    "importer", "distributor", "wholesaler", "retail chain", "clinic", "salon", "spa", "company", "nhà nhập khẩu",
    "nhà phân phối", "bán lẻ",
)
CITY_CONTACT_WORDS = (
    "address", "contact", "office", "store", "stores", "hotline", "headquarters", "located", "location",
)
LOCAL_LANGUAGE_MARKERS = {
    "Vietnam": ("công ty", "trang chủ", "liên hệ", "sản phẩm", "hệ thống phân phối", "phân phối", "cửa hàng"),
    "Japan": ("株式会社", "会社概要", "お問い合わせ", "販売店", "輸入", "卸売"),
    "Thailand": ("บริษัท", "ติดต่อ", "จำหน่าย", "นำเข้า", "ผู้จัดจำหน่าย"),
    "Indonesia": ("perusahaan", "hubungi kami", "distributor", "impor", "grosir"),
    "Germany": ("unternehmen", "kontakt", "impressum", "großhandel", "importeur"),
    "France": ("société", "contact", "distributeur", "importateur", "grossiste"),
    "Taiwan": ("公司", "聯絡我們", "進口", "代理", "經銷", "批發"),
    "Mexico": ("empresa", "contacto", "importador", "distribuidor", "mayorista"),
    "United Arab Emirates": ("trading llc", "general trading", "fzco", "dubai", "distribution"),
}
CITY_MARKERS = {
    "Vietnam": ("ho chi minh", "hanoi", "ha noi", "da nang", "can tho", "hai phong"),
    "Japan": ("tokyo", "osaka", "yokohama", "nagoya", "fukuoka", "sapporo"),
    "Thailand": ("bangkok", "chiang mai", "phuket", "chonburi"),
    "Indonesia": ("jakarta", "surabaya", "bandung", "medan", "bali"),
    "Germany": ("berlin", "hamburg", "munich", "münchen", "frankfurt", "cologne"),
    "France": ("paris", "lyon", "marseille", "toulouse", "nice"),
}

# ---------------------------------------------------------------- fixed values: phones

PHONE_HINTS = (
    "phone", "telephone", "tel", "hotline", "mobile", "call us", "điện thoại", "dien thoai", "số điện thoại",
    "so dien thoai", "liên hệ", "lien he",
)
NON_PHONE_HINTS = (
    "business code", "registration number", "registration no", "company number", "tax code", "tax id",
    "enterprise code", "license number", "mã số doanh nghiệp", "ma so doanh nghiep", "mã số thuế", "ma so thue",
    "đkkd", "gpkd", "giấy cnđkdn", "cnđkdn", "giay cndkdn", "cndkdn",
)
VIETNAM_PHONE_STARTS = ("02", "03", "05", "07", "08", "09", "18", "19")

# ---------------------------------------------------------------- fixed values: company names

NAME_NOISE = (
    r"facebook", r"twitter", r"youtube", r"instagram", r"tiktok", r"linkedin",
    r"mục\s+danh\s+sách(?:\s*#?\d+)?", r"danh\s+mục\s+sản\s+phẩm", r"tìm\s+kiếm\s+sản\s+phẩm",
    r"skip\s+to\s+content", r"chuyển\s+đến\s+phần\s+nội\s+dung", r"see\s+more", r"đăng\s+nhập",
    r"giỏ\s+hàng", r"search\s+products?", r"product\s+categories",
)
LEGAL_PREFIXES = ("công ty", "cong ty")
LEGAL_FORMS = (r"tnhh", r"cp\b", r"cổ phần", r"co phan", r"trách nhiệm hữu hạn")
LEGAL_SPAN_STOPS = (
    r"[|\n]", r"trang chủ", r"giới thiệu", r"hotline", r"địa chỉ", r"điện thoại", r"email", r"bỏ qua",
    r"mst\s*:", r"mã số thuế", r"sđt\s*:", r"copyright", r"facebook", r"twitter", r"youtube", r"instagram",
    r"mục\s+danh\s+sách", r"danh\s+mục\s+sản\s+phẩm", r"tìm\s+kiếm\s+sản\s+phẩm",
)
OPERATOR_TERMS = (
    "phân phối độc quyền bởi", "được phân phối bởi", "đơn vị phân phối", "đơn vị chủ quản", "vận hành bởi",
    "operated by", "distributed by", "exclusive distributor",
)
GENERIC_NAMES = (
    "home", "homepage", "official site", "trang chủ", "welcome", "my blog", "blog", "about us", "contact", "shop",
    "store", "flatsome", "hazo", "wordpress", "website", "untitled", "top", "site blueprint", "website blueprint",
)
THEME_NAME_PARTS = ("flatsome", "my blog", "wordpress theme")
MENU_NAME_TERMS = ("skip to content", "đăng nhập", "giỏ hàng")
GENERIC_BRANDS = ("home", "homepage", "official site", "trang chủ", "shop", "store")
MARKETING_WORDS = ("giá tốt", "cao cấp", "giá rẻ", "uy tín", "chất lượng cao")
TITLE_SEPARATORS = (" | ", " — ", " – ", " :: ", " - ")
ORGANISATION_TYPES = ("Organization", "Corporation", "LocalBusiness", "Store")

# Menu phrases removed from a description.
SUMMARY_UI_PATTERNS = (
    r"add anything here or just remove it(?:\.\.\.)?", r"nhập email và mật khẩu(?: của bạn)?\s*:?",
    r"bạn quên mật khẩu\s*\??", r"quên mật khẩu\s*\??", r"tạo tài khoản", r"khôi phục mật khẩu",
    r"nhập email(?: của bạn)?\s*:?", r"mật khẩu\s*:?", r"tài khoản", r"yêu thích\s*\(\s*0\s*sản phẩm\s*\)",
    r"hiện chưa có sản phẩm(?:\s+sản phẩm)?", r"chưa có sản phẩm(?: nào)?(?:\s+trong)?\s*\.?",
    r"quay trở lại cửa hàng", r"giỏ hàng trống", r"tuyển dụng",
)
SUMMARY_MENU_PATTERNS = (
    r"skip to content", r"home", r"contact us", r"search for", r"see all results", r"previous slide",
    r"next slide", r"see more", r"bỏ qua nội dung", r"chuyển đến phần nội dung", r"trang chủ",
    r"danh mục sản phẩm", r"tìm kiếm(?: sản phẩm)?", r"đăng ký", r"đăng nhập", r"giỏ hàng", r"menu",
    r"xem thêm",
)
SUMMARY_SKIPPED = ("privacy", "cookie", "career", "recruit", "login", "sign in")

# ---------------------------------------------------------------- fixed values: creators

CREATOR_TERMS = (
    "influencer", "content creator", "digital creator", "blogger", "vlogger", "reviewer", "koc", "kol", "ugc creator",
    "makeup artist", "beauty creator", "beauty blogger", "lifestyle creator", "travel creator", "creator",
)
COLLAB_TERMS = (
    "collab", "collaboration", "booking", "business inquiries", "business enquiry", "pr contact", "work with me",
    "brand partnership", "ugc", "review",
)
BUSINESS_ACCOUNT_TERMS = (
    "official store", "official shop", "company", "corporation", "clinic", "hospital", "shopping mall", "wholesale",
    "manufacturer", "distributor", "brand official",
)
MEDIA_ACCOUNT_TERMS = ("magazine", "editorial", "media outlet", "official page", "official account", "news", "folio")
FIRST_PERSON_TERMS = ("i'm", "i am", "my ", "me •", "mom ", "wife ", "founder of")
LOGIN_PAGE_TERMS = ("instagram login", "log in • instagram", "sign up • instagram")
RESERVED_PROFILE_PATHS = (
    "p", "reel", "reels", "tv", "stories", "explore", "accounts", "direct", "about", "developer", "legal", "press",
    "web", "challenge", "api", "privacy",
)
PROFILE_HOSTS = ("instagram.com", "m.instagram.com")
NON_CONTACT_MAIL_HOSTS = ("instagram.com", "facebook.com", "example.com", "email.com")
FOLLOWER_WORDS = (r"followers?", r"팔로워", r"người\s+theo\s+dõi", r"pengikut", r"ผู้ติดตาม")
CREATOR_CATEGORIES = {
    "beauty": ("beauty", "skincare", "makeup", "cosmetics", "K-beauty"),
    "fashion": ("fashion", "style", "accessories", "streetwear", "K-fashion"),
    "food_health": ("food", "wellness", "healthy lifestyle", "nutrition", "K-food"),
    "parenting": ("parenting", "mom creator", "family lifestyle", "kids products"),
    "living": ("lifestyle", "home decor", "living", "daily life"),
    "travel": ("travel", "local guide", "travel creator", "city guide"),
}
DEFAULT_CREATOR_KEYWORDS = ("creator", "reviewer", "influencer")
CREATOR_LOCAL_TERMS = {
    "Vietnam": ("Việt Nam", "Vietnam", "beauty blogger Vietnam", "KOC Vietnam"),
    "Thailand": ("Thailand", "Thai creator", "บิวตี้บล็อกเกอร์"),
    "Indonesia": ("Indonesia", "Indonesian creator", "beauty blogger Indonesia"),
    "Malaysia": ("Malaysia", "Malaysian creator"),
    "Philippines": ("Philippines", "Filipino creator"),
    "Japan": ("Japan", "Japanese creator", "美容インフルエンサー"),
    "United States": ("United States", "US creator"),
}
FLAG_COUNTRIES = (
    ("🇻🇳", "Vietnam"),
    ("🇹🇭", "Thailand"),
    ("🇮🇩", "Indonesia"),
    ("🇲🇾", "Malaysia"),
    ("🇵🇭", "Philippines"),
    ("🇯🇵", "Japan"),
    ("🇺🇸", "United States"),
    ("🇰🇷", "Korea"),
    ("🇳🇱", "Netherlands"),
    ("🇩🇪", "Germany"),
    ("🇲🇽", "Mexico"),
    ("🇬🇧", "United Kingdom"),
    ("🇫🇷", "France"),
    ("🇪🇸", "Spain"),
    ("🇮🇹", "Italy"),
    ("🇨🇦", "Canada"),
    ("🇦🇺", "Australia"),
    ("🇮🇳", "India"),
    ("🇧🇷", "Brazil"),
    ("🇨🇳", "China"),
    ("🇸🇬", "Singapore"),
    ("🇹🇼", "Taiwan"),
    ("🇹🇷", "Turkey"),
    ("🇦🇪", "UAE"),
)
CITY_COUNTRIES = (
    ("hanoi", "Vietnam"),
    ("ho chi minh", "Vietnam"),
    ("saigon", "Vietnam"),
    ("da nang", "Vietnam"),
    ("bangkok", "Thailand"),
    ("jakarta", "Indonesia"),
    ("kuala lumpur", "Malaysia"),
    ("manila", "Philippines"),
    ("tokyo", "Japan"),
    ("osaka", "Japan"),
    ("seoul", "Korea"),
    ("amsterdam", "Netherlands"),
    ("cincinnati", "United States"),
    ("new york", "United States"),
    ("los angeles", "United States"),
    ("berlin", "Germany"),
    ("mexico city", "Mexico"),
    ("london", "United Kingdom"),
    ("paris", "France"),
    ("madrid", "Spain"),
)

# Header names accepted for each field of an uploaded creator file, in order of preference.
CREATOR_HEADERS = {
    "creator_id": ("후보ID", "샘플ID", "ID"),
    "record_kind": ("데이터구분",),
    "display_name": ("표시명", "표시명(가상)"),
    "handle": ("핸들", "핸들(가상)"),
    "country": ("국가",),
    "category": ("카테고리",),
    "followers": ("팔로워", "팔로워(가상)"),
    "engagement": ("참여율", "참여율(가상)"),
    "account_type": ("계정유형", "계정유형(가상)"),
    "email": ("연락이메일", "연락이메일(가상)"),
    "profile_url": ("프로필출처URL",),
    "email_source_url": ("이메일출처URL",),
    "status": ("검증상태",),
}
