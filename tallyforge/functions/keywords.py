"""Words that tell a category, and the rules every ledger starts with.  Data only; see :func:`tallyforge.operators.ledger.keyword_category`."""

from __future__ import annotations

# Merchant words in their order (pattern, category, direction, whether the invoice's items tell more).
MERCHANT_WORDS = (
    ("薪|salary|payroll|工資|獎金|bonus", "income.salary", "inflow", False),
    ("股利|股息|配息|利息|收益分配|dividend|interest", "income.investment", "inflow", False),
    ("回饋|退稅|補助|津貼|稿費|cashback", "income.other", "inflow", False),
    (r"apple\.com\/bill|\bapp\s*store\b|google\s*\*?\s*play|tradingview|trend\s*micro|趨勢科技", "tech", "outflow", False),
    (r"line\s*禮物|line\s*gift", "misc", "outflow", False),
    (r"uber\s*\*?\s*eats|foodpanda|熊貓", "food", "outflow", False),
    (r"星巴克|starbucks|路易莎|louisa|\bcama\b|85度c|五十嵐|50嵐|清心福全|可不可|迷客夏|茶湯會|coco都可|春水堂|大苑子|得正|麻古|鶴茶樓|comebuy|老虎堂|珍煮丹|咖啡|coffee|cafe|茶飲|飲料|飲品|手搖|豆花|冰(?!箱|櫃)", "food", "outflow", False),
    ("全聯|家樂福|carrefour|好市多|costco|美廉社|頂好|wellcome|楓康|愛買|城市超市|jasons|超市|市場|果菜|生鮮", "food", "outflow", False),
    (r"7-?eleven|7-?11|統一超商|全家(?!福)|familymart|family mart|萊爾富|hi-?life|ok\s*mart|ok超商|ok便利|超商", "food", "outflow", True),
    (r"麥當勞|mcdonald|肯德基|kfc|摩斯|mos burger|漢堡王|burger king|popeyes|\bsubway\b|牛排(?!刀)|steak\s*house|必勝客|pizza hut|達美樂|domino|拿坡里|鼎泰豐|八方雲集|四海遊龍|爭鮮|壽司郎|sushiro|藏壽司|瓦城|王品|饗賓|築間|海底撈|胡椒|牛肉麵|便當|自助餐|小吃|麵店|麵館|餐廳|餐館|餐飲|食堂|火鍋|燒肉|拉麵|早餐|美食|小館|飯館|食品行|壽司|麵(?!粉)|(?<!電子?)飯(?!店)|餐(?!具|桌|椅|券)|(?<!電子?)鍋(?!具)", "food", "outflow", False),
    (r"uber|計程車|taxi|台灣大車隊|55688|yoxi|line\s*taxi|linego|bolt", "transport", "outflow", False),
    ("中油|cpc|台塑石油|全國加油|加油站|停車|parking|嘟嘟房|俥亭|etag|遠通電收|洗車", "transport", "outflow", False),
    ("悠遊卡|easycard|捷運|metro|高鐵|thsr|台鐵|臺鐵|鐵路局|客運|國光|統聯|youbike|微笑單車", "transport", "outflow", False),
    ("台電|台灣電力|自來水|台水|瓦斯|天然氣|水費|電費", "housing", "outflow", False),
    ("中華電信|遠傳|台灣大哥大|台哥大|台灣之星|亞太電信|中嘉|凱擘|hinet|電信|寬頻", "housing", "outflow", False),
    ("房租|租金|房貸|管理費|物業", "housing", "outflow", False),
    (r"chatgpt|openai|anthropic|claude|cursor|github|gitlab|jetbrains|notion|dropbox|adobe|figma|slack|zoom|microsoft\s*365|office\s*365|google\s*\*?\s*(?:one|storage|workspace|cloud)|\baws\b|amazon\s*web\s*services|cloudflare|godaddy|namecheap|gandi|digitalocean|linode|vercel|heroku|icloud|網域|虛擬主機|主機代管|\bssl\b|\bdomain\b|\bhosting\b|雲端", "tech", "outflow", False),
    (r"netflix|spotify|youtube|disney\s*\+|disney plus|kkbox|friday影音|linetv|nintendo\s*online|playstation\s*plus|訂閱", "entertainment", "outflow", False),
    (r"momo|富邦媒體|pchome|網路家庭|蝦皮|shopee|酷澎|coupang|amazon|淘寶|taobao|露天|yahoo\s*購物|博客來|books\.com", "shopping", "outflow", False),
    (r"燦坤|全國電子|三創|nova|順發|apple\s*store|studio\s*a|小米|xiaomi|良興|迪卡儂", "tech", "outflow", False),
    (r"uniqlo|zara|h&m|lativ|nike|adidas|new balance|asics|net服飾|gu\b|服飾|鞋", "shopping", "outflow", False),
    ("屈臣氏|康是美|寶雅|小北百貨|大創|daiso|無印良品|muji|ikea|宜家|特力屋|hola|生活工場|日藥本舖|松本清|光南", "shopping", "outflow", False),
    ("百貨|新光三越|遠東|sogo|微風|京站|誠品生活", "shopping", "outflow", True),
    (r"航空|airlines|長榮|華航|星宇|starlux|虎航|tigerair|agoda|booking\.com|airbnb|klook|kkday|trip\.com|雄獅|可樂旅遊|飯店|酒店|hotel|旅館|民宿|旅行社", "entertainment", "outflow", False),
    ("威秀|vieshow|影城|秀泰|錢櫃|好樂迪|steam|valve|playstation|nintendo|任天堂|拓元|kktix|年代售票|健身|world gym|遊樂", "entertainment", "outflow", False),
    ("補習|課程|hahow|udemy|coursera|書店|金石堂|誠品書店", "misc", "outflow", False),
    ("人壽|產險|保險|健保|勞保|保費|insurance", "health", "outflow", False),
    ("醫院|診所|牙醫|醫療|掛號|藥局|藥房|杏一|大樹藥局|長庚|榮總|馬偕", "health", "outflow", False),
    ("捐款|基金會|慈濟|家扶|世界展望會|創世|紅十字|donation", "donation", "outflow", False),
    ("紅包|禮金|喜宴|奠儀", "misc", "outflow", False),
    ("國稅局|稅務局|牌照稅|燃料稅|所得稅|綜所稅|房屋稅|地價稅|稅款", "misc", "outflow", False),
    (r"手續費|年費|服務費|遲繳|違約金|循環利息|\bfee\b", "misc", "outflow", False),
    (r"無卡提款|atm\s*提款|跨行提款|提款(?!卡|機)", "misc", "outflow", False),
)
# item words in their order (pattern, category)
ITEM_WORDS = (
    ("悠遊卡加值|一卡通加值|加值|車票|高鐵|台鐵|捷運|客運|票價", "transport"),
    ("汽油|無鉛|柴油|停車費|洗車", "transport"),
    ("拿鐵|美式|咖啡|latte|americano|cappuccino|珍奶|珍珠奶茶|奶茶|紅茶|綠茶|烏龍|青茶|果汁|豆漿|可樂|汽水|茶飲|冰沙|多多|氣泡水|礦泉水|飲料|奶昔|養樂多|檸檬|鮮奶茶|咖啡牛奶", "food"),
    ("便當|餐盒|飯糰|御飯糰|三明治|漢堡|拉麵|炒飯|燴飯|丼|套餐|鍋|水餃|餃|包子|饅頭|粥|沙拉|壽司|披薩|pizza|雞排|鹹酥雞|關東煮|熱狗|滷味|早餐|午餐|晚餐|小籠包|排餐|義大利麵|咖哩|炸雞|薯條|蛋餅|吐司|貝果|鬆餅|麵包|蛋糕|甜點|布丁|麵$|牛肉麵|湯麵|乾麵|涼麵|燒肉|烤肉|餐$", "food"),
    ("蔬菜|蔬果|水果|生鮮|豬肉|雞肉|牛肉(?!麵)|雞胸|雞蛋|鮮乳|牛奶|白米|麵條|醬油|沙拉油|調味|豆腐|冷凍|零食|餅乾|洋芋片|泡麵|罐頭|優格|起司|米$|蛋$", "food"),
    ("衛生紙|面紙|抽取式|廚房紙巾|洗衣|洗碗|清潔|牙膏|牙刷|洗髮|沐浴|衛生棉|尿布|垃圾袋|電池|保鮮|濕紙巾|洗手|乳液|口罩|棉花棒|刮鬍|購物袋|塑膠袋", "shopping"),
    (r"\bssl\b|憑證|\bdomain\b|網域|\bhosting\b|虛擬主機|主機代管|雲端|\bapi\b|訂閱方案|軟體|授權|license", "tech"),
    ("充電|傳輸線|耳機|滑鼠|鍵盤|記憶卡|隨身碟|行動電源|iphone|ipad|macbook|手機|螢幕|電腦|筆電|硬碟|吹風機|電風扇|家電", "tech"),
    ("襪|上衣|長褲|短褲|外套|t恤|帽|鞋|內衣|洋裝|襯衫", "shopping"),
    ("藥|維他命|ok繃|掛號費|部分負擔|診察|醫療", "health"),
    ("書籍|雜誌|課程|教材|講義", "misc"),
    ("電影票|門票|入場|遊戲點數|點數卡", "entertainment"),
    ("電費|水費|瓦斯費", "housing"),
    ("電信費|月租費|網路費", "housing"),
    ("手續費", "misc"),
)
# system rules (id, category_id, economic_role, target_type, field, pattern, priority, excluded, direction); all are regular expressions
SYSTEM_RULES = (
    ("system:bank:salary-keywords", "income.salary", None, "bank_transaction", "any_text", "薪|salary|payroll|工資|獎金|bonus", 110, False, "inflow"),
    ("system:bank:investment-income-keywords", "income.investment", None, "bank_transaction", "description", r"^(?!.*(?:退刷|退款|退貨|折抵|利息調整|利息退還|貸款|借款|融資|循環利息|手續費)).*(?:^利息$|利息存入|存款利息|活存利息|定存利息|股息|股利|配息|^interest$|\binterest\s+(?:credit|income)\b|\bdividends?\b)", 109, False, "inflow"),
    ("system:bank:other-income-keywords", "income.other", None, "bank_transaction", "description", r"^(?!.*(?:退刷|退款|退貨|折抵|貸款|借款|融資|手續費)).*(?:現金回饋|回饋金|現金回存|租金補貼|租屋補助|育兒津貼|生育補助|政府補助|稿費|稿酬|接案收入|退稅|\bcashback\b)", 108, False, "inflow"),
    ("system:bank:software-keywords", "tech", None, "bank_transaction", "description", r"^(?!.*(?:手續費|交易服務費|\bforeign\s+transaction\s+fee\b)).*(?:\b(?:openai|cursor|cloudflare)(?:\b|o[0-9])|\bchatgpt\b|\banthropic\b|\bclaude(?:\.ai|\s+(?:pro|max|subscription))\b|\bgoogle\s*[* ]\s*(?:cloud|one|workspace)\b|\b(?:github|jetbrains|adobe|notion|dropbox)(?:\b|o[0-9])|\b(?:microsoft|office)\s*365\b|\bicloud\b|\baws\b|amazon\s+web\s+services|\bgodaddy\b|\bnamecheap\b|\bgandi\b|\bdigitalocean\b|\blinode\b|\bvercel\b|\bheroku\b)", 108, False, "any"),
    ("system:bank:streaming-keywords", "entertainment", None, "bank_transaction", "description", r"^(?!.*(?:手續費|交易服務費)).*(?:\bnetflix\b|\bspotify\b|\bkkbox\b|disney\s*\+|\byoutube\s*premium\b|friday影音|\blinetv\b)", 108, False, "any"),
    ("system:bank:utilities-keywords", "housing", None, "bank_transaction", "description", "^(?!.*(?:手續費|交易服務費|購機|手機|設備|門市|商城|購物)).*(?:台灣電力|台灣自來水|臺北自來水|台北自來水|台電|台水|水費|電費|瓦斯費|天然氣費)", 108, False, "any"),
    ("system:bank:telecom-keywords", "housing", None, "bank_transaction", "description", r"^(?!.*(?:手續費|交易服務費|購機|手機|設備|門市|商城|購物)).*(?:中華電信|遠傳電信|台灣大哥大|台灣之星|亞太電信|電信費|電話費|網路費|寬頻費|\bhinet\b)", 108, False, "any"),
    ("system:bank:ewallet-topup", None, "own_transfer", "bank_transaction", "any_text", "^(?!.*手續費).*(?:電支.{0,12}儲值|(?:街口|連加|一卡通|全支付|悠遊付|全盈|icash ?pay|line ?pay).{0,8}儲值)", 107, True, "any"),
    ("system:bank:creditcard-payment", None, "card_payment", "bank_transaction", "any_text", "信用卡.*繳|信用卡款|繳卡費|credit.?card.*(pay|bill|repay)", 106, True, "any"),
    ("system:bank:transfer-keywords", None, None, "bank_transaction", "any_text", "轉帳|轉入|轉出|匯款|transfer|remit|atm|跨行", 105, False, "any"),
    ("system:shared:drinks-keywords", "food", None, None, "any_text", "咖啡|飲料|茶飲|手搖|cafe|coffee|starbucks|星巴克|路易莎|louisa", 101, False, "any"),
    ("system:shared:dining-keywords", "food", None, None, "any_text", r"餐|飯(?!店)|小吃|麵店|麵館|牛肉麵|拉麵|便當|火鍋|早餐|food|restaurant|mcdonald|麥當勞|uber\s*eats|foodpanda", 100, False, "any"),
    ("system:bank:investment-keywords", None, "investment", "bank_transaction", "any_text", r"投資|證券|股票|基金(?!會)|\betf\b|broker|tdcc|交割", 100, False, "any"),
    ("system:shared:transit-keywords", "transport", None, None, "any_text", "捷運|高鐵|台鐵|臺鐵|客運|悠遊卡|metro|rail|thsr", 100, False, "any"),
    ("system:shared:ride-keywords", "transport", None, None, "any_text", r"計程車|大車隊|taxi|uber(?!\s*\*?\s*eats)", 100, False, "any"),
    ("system:shared:car-keywords", "transport", None, None, "any_text", "加油|中油|台塑石油|停車|parking|fuel|etag", 100, False, "any"),
    ("system:shared:transport-keywords", "transport", None, None, "any_text", "交通|transport", 99, False, "any"),
    ("system:shared:tax-keywords", "misc", None, None, "any_text", "稅費|稅款|國稅|稅務局|牌照稅|燃料稅|所得稅|地價稅|房屋稅", 96, False, "outflow"),
    ("system:shared:insurance-keywords", "health", None, None, "any_text", "健保|勞保|保費|保險|人壽|insurance", 95, False, "any"),
    ("system:shared:medical-keywords", "health", None, None, "any_text", "醫院|診所|牙醫|牙科|藥局|醫療", 95, False, "any"),
    ("system:shared:housing-keywords", "housing", None, None, "any_text", "房租|租金|房貸|管理費", 95, False, "any"),
    ("system:shared:grocery-keywords", "food", None, None, "any_text", "全聯|家樂福|carrefour|好市多|costco|美廉社|超市|market", 91, False, "any"),
    ("system:shared:convenience-keywords", "food", None, None, "any_text", "超商|7-?eleven|seven|familymart|全家|萊爾富|hi-?life", 91, False, "any"),
    ("system:shared:electronics-keywords", "tech", None, None, "any_text", r"燦坤|全國電子|三創|順發3c|apple\s*store|studio\s*a", 91, False, "any"),
    ("system:shared:online-shopping-keywords", "shopping", None, None, "any_text", "momo|pchome|蝦皮|shopee|酷澎|coupang", 91, False, "any"),
    ("system:shared:fee-keywords", "misc", None, None, "any_text", "手續|年費|fee|charge|利息|interest", 90, False, "any"),
    ("system:shared:shopping-keywords", "shopping", None, None, "any_text", "購物|商店|百貨|store|shop", 90, False, "any"),
)


def system_rules(target: str) -> list[dict]:
    """The rules that apply to ``bank_transaction`` or ``invoice``, as :func:`tallyforge.operators.ledger.classify` takes them."""
    names = ("id", "category_id", "economic_role", "target_type", "field", "pattern", "priority", "excluded", "direction")
    rows = (dict(zip(names, r, strict=True)) for r in SYSTEM_RULES)
    return [r | {"operator": "regex"} for r in rows if r["target_type"] in (None, target)]


def merchant_words() -> list[tuple[str, str, str]]:
    return [(p, c, d) for p, c, d, _ in MERCHANT_WORDS]
