"""Fixed values.

Everything in this module is a constant that results depend on: word lists, lookup tables, patterns,
thresholds and messages. They are data, stated as plain text in their natural order.
"""

# ------------------------------------------------------------------ roles and limits
ROLES = ["employee", "hr", "finance", "legal", "it", "executive"]
TOP_K = 5
RRF_K = 60
BM25_K1 = 1.4
BM25_B = 0.72
EXPANSION_WEIGHT = 0.6
CHAR_BLOCK_WEIGHT = 0.6
CHAR_NGRAMS = (3, 5)
SVD_COMPONENTS = 192
SUPERSEDED_FACTOR = 0.35
PASSAGE_SIZE = 520
PASSAGE_OVERLAP = 60
SEPARATORS = ["\n\n", "\n", "۔", ". ", "؟ ", "? ", "، ", ", ", " ", ""]
MAX_UPLOAD_BYTES = 5 * 1024 * 1024
MAX_UNPACKED_BYTES = 100 * 1024 * 1024
MAX_PDF_PAGES = 200
MAX_UPLOAD_CHARS = 200_000
MIN_UPLOAD_CHARS = 20
UPLOAD_TTL_MIN = 30
MAX_UPLOADS_PER_SESSION = 3
MAX_SESSIONS = 500
READS_PER_MIN = 240
WRITES_PER_MIN = 30
MAX_IDF_WEIGHT = 6.0
EMPTY_IDF_WEIGHT = 3.0
MIN_SUPPORT = 0.4
# Least best support of a question with several unknown terms, and with one.
UNKNOWN_TERMS_SUPPORT = 0.75
UNKNOWN_TERM_SUPPORT = 0.6
# Parts of a sentence's score: coverage with and without its section, support of its source, rank, word pairs, older version, number.
SECTION_WEIGHT = 0.5
SENTENCE_WEIGHT = 0.5
SOURCE_WEIGHT = 0.15
RANK_WEIGHT = 0.03
PAIR_WEIGHT = 0.12
MOST_PAIRS = 2
SUPERSEDED_WEIGHT = 0.3
NUMBER_WEIGHT = 0.12
# A neighbour is quoted along if it is among so many best sentences and scores so large a share of the best.
QUOTED_FROM = 4
NEIGHBOUR_SHARE = 0.85

# ------------------------------------------------------------------ tokens (Java regular expressions)
AR_LETTERS = r"[\x{600}-\x{6FF}]"
# Python's \d is \p{Nd} in Java; its \s is the class below.
WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"
EOL = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
AR_MARKS = r"[\x{610}-\x{61A}\x{64B}-\x{65F}\x{670}\x{6D6}-\x{6ED}\x{640}]"
AR_FOLD = ("إأآٱىؤئة", "اااايويه")
TOKEN = r"[A-Za-z]+\p{Nd}+|[A-Za-z]+|[\x{621}-\x{64A}]+|\p{Nd}+(?:[.,]\p{Nd}+)*%?"
SENTENCE_GAP = rf"(?<=[.!?؟]){WS}+(?=[A-Z\x{{600}}-\x{{6FF}}\p{{Nd}}\"(])"
LIST_MARKER = rf"^(?:[-•*]|\p{{Nd}}+[.)]){WS}+"
NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
AR_DIGITS = "٠١٢٣٤٥٦٧٨٩"

EN_STOP = """a an and are as at be been by can could do does for from had has have how i if in is it its
me my of on or our shall should so than that the their them then there these they this to up was we were what when
where which who whom why will with would you your about any after all also am into more most no not only other out
over same some such very just get got per did done does someone anyone anybody far number tell show say says
give summarise summarize require requires required handle handles accept explain describe list please""".split()

AR_STOP = """في من على إلى الى عن مع هل ما ماذا متى متي كيف كم هو هي هذا هذه ذلك تلك التي الذي الذين أو او ثم قد كان بشأن بشان عدد
كانت يكون تكون لا لم لن إن ان أن عند كل بعد قبل بين أي اي هناك لدى لي له لها لهم نحن أنا انا يجب يمكن""".split()

QUESTION_WORDS = """long allow allowed submit need needed much many get take give use pay paid yearly often quickly must required
can could may happen happens kind type amount level time times first last limit day days""".split()

AR_PREFIXES = "وال بال كال فال لل ال".split()
AR_SUFFIXES = "هما كما ات ون ين ها هم يه ه ي".split()

# ------------------------------------------------------------------ questions and answers
REFUSAL = {
    "en": "I couldn't find this in the documents you have access to.",
    "ar": "لم أجد هذه المعلومة في المستندات المتاحة لك.",
}
NOT_FOUND = "NOT_FOUND"
APOLOGIES = ["I couldn't", "I could not", "لم أجد"]
_WORD = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
NUMERIC_QUESTION = (
    rf"(?iu){_EDGE}(how (many|much|long|far|quickly|soon|often)|when|within|what ({_WORD}+ ){{0,3}}"
    r"(limit|price|budget|fee|rate|amount|minimum|maximum|time|percentage|level|salary|band|target|allowance|number|"
    rf"hours|length)s?){_EDGE}|كم|متى|خلال|الحد"
)

# ------------------------------------------------------------------ planted instructions
INJECTION = (
    rf"(?iu)(ignore|disregard|forget|override){WS}+(all{WS}+|any{WS}+|the{WS}+)?(previous|prior|above|earlier|your){WS}+"
    r"(instructions|rules|prompts?|guidelines)"
    rf"|note{WS}+to{WS}+(any{WS}+)?(ai|assistant|language model|llm|chatbot)"
    r"|(you are now|act as|pretend to be|new instructions:|system prompt)"
    rf"|(reveal|include|print|show){WS}+(the{WS}+|all{WS}+|every{WS}+|full{WS}+)*(salary|iban|password|system prompt|secret)"
    rf"|تجاهل{WS}+(جميع{WS}+|كل{WS}+)?التعليمات|انت الان|تعليمات جديدة"
)

# ------------------------------------------------------------------ personal data, in order of precedence
_D = r"\p{Nd}"
PII_PATTERNS = {
    "emirates_id": rf"{_EDGE}784(?:-|{WS})?{_D}{{4}}(?:-|{WS})?{_D}{{7}}(?:-|{WS})?{_D}{_EDGE}",
    "iban": rf"(?iu){_EDGE}AE{WS}?{_D}{{2}}(?:{WS}?{_D}){{19}}{_EDGE}",
    "passport": rf"(?iu){_EDGE}(?:passport(?: no\.?| number)?:?{WS}*)([A-Z]{_D}{{7,8}}){_EDGE}",
    "phone": rf"(?:\+971|00971|{_EDGE}0){WS}?5{_D}(?:{WS}|-)?{_D}{{3}}(?:{WS}|-)?{_D}{{4}}{_EDGE}",
    "email": rf"{_EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_EDGE}",
    "card": rf"{_EDGE}(?:{_D}[ -]?){{13,19}}{_EDGE}",
}
PII_LABELS = {"emirates_id": "EMIRATES ID", "iban": "IBAN", "card": "CARD NUMBER", "passport": "PASSPORT",
              "phone": "PHONE", "email": "EMAIL"}
PII_ALWAYS = ["emirates_id", "iban", "card", "passport"]
CONTACT_ROLES = ["it", "executive"]
CONTACT_DOCS = ["runbook"]
SHARED_MAILBOX = r"(?iu)^(hr|hr\.desk|security|dpo|ethics|info|support|procurement|careers|finance|legal|it)@"

# ------------------------------------------------------------------ evaluation
ANSWERABLE = ["fact", "cross", "version"]
GATE_FLOORS = {"retrieval.hybrid.hit5": 0.95, "answers.accuracy": 0.85, "answers.cross_accuracy": 0.8,
               "refusal.unanswerable": 0.85, "refusal.restricted": 0.85}
GATE_ZERO = ["leaks.restricted", "leaks.pii", "leaks.injection", "leaks.superseded"]

# ------------------------------------------------------------------ request validation
ROLE_PATTERN = "^(employee|hr|finance|legal|it|executive)$"
SESSION_PATTERN = "^[A-Za-z0-9]{8,40}$"
DOC_ID_PATTERN = "^[a-z_0-9]{2,40}$"
UPLOAD_ID_PATTERN = "^up_[a-f0-9]{8}$"

# ------------------------------------------------------------------ glossary
# Arabic workplace term = English words
ARABIC_TO_ENGLISH = """
رمضان = ramadan
ساعات = hours
ساعة = hour
العمل = working work
عمل = work working
دوام = working hours
اسبوع = week
اسبوعيا = weekly week
يوم = day
يوما = days
ايام = days
شهر = month
شهريا = monthly month
سنة = year
سنويا = yearly year annual
سنوي = annual
المنزل = home remote
عن بعد = remote
بعد = remote
التجربة = probation
تجربة = probation
الاشعار = notice
اشعار = notice
استقالة = resignation notice
الجديد = new
جديد = new
الاب = father paternity
الام = mother maternity
موظف = employee
الموظف = employee
الموظفين = employees
مدير = manager
المدير = manager
مستودع = warehouse
المستودع = warehouse
سائق = driver
عطلة = holiday
العطلات = holidays
الرسمية = public official
عيد = holiday eid
مدة = length period long
اجازة = leave
الاجازة = leave
اجازات = leave
الاجازات = leave
السنوية = annual
مرضية = sick
المرضية = sick
الامومة = maternity
امومة = maternity
الابوة = paternity
والدية = paternity parental
الحداد = bereavement
الحج = hajj
الدراسة = study exam
ترحيل = carry over
رصيد = balance unused
راتب = salary pay
الراتب = salary pay
رواتب = salary salaries
الرواتب = salary salaries
سلم = band
درجة = grade
بدل = allowance
البدل = allowance
السكن = housing
سكن = housing
المواصلات = transport
مكافاة = bonus
حافز = bonus incentive
زيادة = increase merit
التامين = insurance
تامين = insurance
الطبي = medical
طبي = medical
تذكرة = ticket air
طيران = air flight
اللياقة = wellness gym fitness
البدنية = wellness fitness
رياضة = gym
التعليم = education
تعليم = education
الاطفال = children child
نهاية الخدمة = end-of-service gratuity
مكافاة نهاية = gratuity
تقاعد = pension
السفر = travel trip
سفر = travel trip
رحلة = trip travel
فندق = hotel
الفندق = hotel
الحد = limit
الاقصي = maximum limit
سعر = price limit rate
يومي = daily per diem allowance
اليومي = daily per diem allowance
الخليج = gcc
دول الخليج = gcc
خارج = outside
داخل = within
مصروفات = expense expenses
المصروفات = expense expenses
مطالبة = claim
ايصال = receipt
فاتورة = invoice receipt
سيارة = car
كيلومتر = kilometre
مخالفات = fines
درجة رجال الاعمال = business class
رجال الاعمال = business class
حجز = book booking
دبي = dubai
ابوظبي = abu dhabi
الشارقة = sharjah
عجمان = ajman
كلمة المرور = password
كلمة = password
المرور = password traffic
طول = length long
الادني = minimum
الحد الادني = minimum
حرفا = characters
التحقق = authentication mfa
حاسوب = laptop computer
الحاسوب = laptop computer
مفقود = lost
سرقة = stolen
التصيد = phishing
احتيالي = phishing suspicious
حادث = incident
حادثة = incident
الحوادث = incidents
امني = security
الامن = security
فدية = ransomware ransom
تصنيف = classification
البيانات = data
بيانات = data
سرية = confidential
مقيدة = restricted
الاتصال = call contact
رقم = number
حماية = protection
مسؤول = officer
الشخصية = personal
شخصية = personal
الاحتفاظ = kept retention
حذف = deleted delete
اختراق = breach
تسريب = breach leak
العملاء = customer customers
تخزين = stored storage
تخزن = stored
الامارات = uae
المشتريات = procurement purchase
شراء = purchase
عروض = quotes
عرض = quote offer proposal
اسعار = quotes prices
مناقصة = tender
لجنة = committee
المورد = supplier
مورد = supplier
الموردين = suppliers
هدية = gift
هدايا = gifts
الدفع = payment
شروط = terms
عقد = contract agreement
العقد = contract agreement
اتفاقية = agreement
انهاء = terminate termination
رسوم = fee fees
الرسوم = fee fees
المحاكم = courts
نزاع = dispute
الايرادات = revenue
ايرادات = revenue
ميزانية = budget
استحواذ = acquire acquisition
المدير المالي = chief financial officer
مجلس الادارة = board
"""

# English word = English words used in the same sense
ENGLISH_SYNONYMS = """
contract = agreement
length = long characters
minimum = least
maximum = limit cap
stick = drive storage
laptop = device computer
salary = pay
fee = fees charge
boss = manager
sack = terminate
fire = terminate
quit = resign notice
vacation = leave
holiday = leave
doctor = medical
illness = sick
receipt = receipts
reimburse = reimbursed
price = cost rate
fine = fines
lost = stolen
hack = incident breach
virus = malware
court = courts disputes
law = governed
bonus = incentive
allowance = per diem
trip = travel
carry = carried
night = nightly
attack = incident ransomware
father = paternity
mother = maternity
stop = no
alternative = instead cash
abroad = outside
"""
