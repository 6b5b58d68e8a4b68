"""Small inline inputs that both engines can be given."""
from __future__ import annotations

# Our own sample phrases.
PHRASES = [(1, "قَالَ المُعَلِّمُ: والكتابُ، نافعٌ!"), (2, "إنّ أحمدَ في البيتِ 12"), (3, "وبعدما كتب الطالب بعدما قرأ"), (4, "بالله وبالحق لله فالله"), (5, "المدرسة الكبرى، شؤون بيئة"), (6, "ولا يكتب فما قرأ"), (7, "كالبحر للناس بالعلم وال"), (8, "الزنا ويلتا حسرتا"), (9, ""), (10, "ـــ 99 _ x")]
GRADES = [(1, "إسناده صحيح"), (1, "ضعيف"), (2, "حسن صحيح"), (2, "رجاله ثقات"), (3, "موضوع"), (3, "لا أصل له"), (4, "باطل بهذا الإسناد"), (4, "صحيح"), (5, "وضعفه جماعة"), (5, "لم يثبت"), (6, "تفرد به فلان"), (7, "بلا إسناد"), (7, "حديث منكر"), (8, "كذب"), (9, "غير صحيح"), (10, "الحسن بن علي")]
WINDOWS = [(1, "وقد قال تعالى في كتابه"), (2, "عن النبي أنه ذكر"), (3, "كلام ﷺ هنا"), (4, "نص عام"), (5, "هل يجوز لي أن أفعل"), (6, "ما حكم هذا الأمر"), (7, "زوجتي تسأل"), (8, "هذا حلال عندهم"), (9, "روي عن رسول الله")]


def values(rows) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
