"""Grade labels.

Fixed values: the pattern (whole string, any case), the Arabic label, the
family, whether the chain alone is judged, whether it is a citation, and a note;
the first that fits counts.
"""

from __future__ import annotations

SAHIH, HASAN, DAIF, MAWDU, NEUTRAL = "صحيح", "حسن", "ضعيف", "موضوع", "neutral"
UNNAMED = "مُخرِّج غير مسمى"
_CHAIN = "حكم على الإسناد"

RULES: list[tuple[str, str, str, bool, bool, str | None]] = [
    ("Isnaad Hasan|Hasan Isnaad", "إسناده حسن", HASAN, True, False, _CHAIN),
    ("Isnaad Sahih|Sahih Isnaad", "إسناده صحيح", SAHIH, True, False, _CHAIN),
    ("Daif Isnaad", "ضعيف الإسناد", DAIF, True, False, _CHAIN),
    ("Daif Isnaad Maqtu", "ضعيف الإسناد مقطوعاً", NEUTRAL, True, False, "حكم على الإسناد (على التابعي)"),
    ("Sahih Isnaad Maqtu", "صحيح الإسناد مقطوعاً", NEUTRAL, True, False, "حكم على الإسناد (على التابعي)"),
    ("Sahih Isnaad Mauquf", "صحيح الإسناد موقوفاً", NEUTRAL, True, False, "حكم على الإسناد (على الصحابي)"),
    ("Sahih - Agreed Upon", "ذُكر في: متفق عليه", NEUTRAL, False, True, None),
    ("Sahih - Bukhari And Muslim", "ذُكر في: البخاري ومسلم", NEUTRAL, False, True, None),
    ("Sahih Muslim.*", "ذُكر في: صحيح مسلم ({})", NEUTRAL, False, True, None),
    ("Sahih Bukhari.*", "ذُكر في: صحيح البخاري ({})", NEUTRAL, False, True, None),
    ("Sahih Mauquf", "صحيح موقوفاً", NEUTRAL, False, False, "على الصحابي"),
    ("Sahih Maqtu", "صحيح مقطوعاً", NEUTRAL, False, False, "على التابعي"),
    ("Batil", "باطل", NEUTRAL, False, False, "حكم مستقل"),
    ("Shadh", "شاذ", NEUTRAL, False, False, "حكم إسنادي خاص"),
    ("Munkar", "منكر", NEUTRAL, False, False, "حكم إسنادي خاص"),
    ("Matruk", "متروك", NEUTRAL, False, False, "حكم على الراوي"),
    ("Munqati", "منقطع", NEUTRAL, False, False, "انقطاع في السند"),
    ("Mursal", "مرسل", NEUTRAL, False, False, "سقط الصحابي من السند"),
    ("Mudallas", "مدلس", NEUTRAL, False, False, "تدليس في الإسناد"),
    ("Maqtu", "مقطوع", NEUTRAL, False, False, "على التابعي"),
    ("Sahih|Sahih Hadith", "صحيح", SAHIH, False, False, None),
    ("Hasan Sahih|Hasan Sahih Isnaad", "حسن صحيح", HASAN, False, False, None),
    ("Hasan", "حسن", HASAN, False, False, None),
    ("Sahih Lighairihi", "صحيح لغيره", SAHIH, False, False, None),
    ("Hasan Lighairihi", "حسن لغيره", HASAN, False, False, None),
    ("Sahih Mutawatir", "صحيح متواتر", SAHIH, False, False, None),
    ("Very Daif|Daif Jiddan", "ضعيف جداً", DAIF, False, False, None),
    ("Daif|Sanad Daif", "ضعيف", DAIF, False, False, None),
    ("Mawdu", "موضوع", MAWDU, False, False, None),
]
