"""Letter templates as data, and one helper that fills their slots.

A template is a list of blocks ``(text, slot)``: the text names its slots in braces, and a block with a slot is left out when
that slot is an empty string. Blocks are joined by line ends.
"""
from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F

Template = tuple[tuple[str, str | None], ...]

# ---------------------------------------------------------------- fixed values: sentences of the drafts

FIRST_LETTER: Template = (
    ("Hello {recipient},\n\n{sentence}\n\nWe are {company}. We would like to introduce {item}, a {category} product.", None),
    ("\n{description}", "description"),
    ("\nThe product information provided to us highlights:\n{highlights}", "highlights"),
    ("\nProduct information: {catalog}", "catalog"),
    ("\nWe believe this product may be relevant to your portfolio. Would you be open to receiving a short "
     "product introduction or catalog for your review?\n\nBest regards,\n{contact}\n{title}\n{company}\n{website}\n{email}\n\n"
     "If this is not relevant to your business, please let us know and we will not follow up.", None),
)
FIRST_LETTER_KO: Template = (
    ("수신: {buyer} / {recipient}\n\n개인화 적용 문장:\n{sentence}", None),
    ("\n{company}가 {item}을 소개하고 제품소개자료 수신 의향을 묻는 첫 연락 초안입니다.", None),
    ("제품 설명(입력값):\n{description}", "description"),
    ("핵심 강점(입력값):\n{highlights}", "highlights"),
    ("\n검수 메모: 발송 전 수신자·개인화 근거·제품 사실을 확인하세요.", None),
)
SUBJECT = "Introducing {item} – {category} for {buyer}"
OPENING_WITH_BASIS, OPENING = "We noticed that {buyer} works with {basis}.", "We came across {buyer}."
IN_COUNTRY = "{opening} in {country}."

OUTREACH_INPUT_NEEDED = "Enter the sender brand and the English product name to create a draft."
OUTREACH_OFFER = "Would you be open to receiving a short product introduction and discussing a possible collaboration?"
OUTREACH_SENDER = "I'm {contact} from {brand}{note}"
OUTREACH_BRAND = "I'm reaching out from {brand}{note}"
OUTREACH_SUBJECT = "Collaboration inquiry from {brand} — {item}"
OUTREACH_FOUND = "Hi {name},\n\nI found your public Instagram profile while researching {field} creators in {country}. {introduction}."
OUTREACH_PRODUCT = "We would like to introduce {item}, a Korean {category}.{benefit}"
OUTREACH_END = "\n\n{offer}\n\n{greeting},\n{signed}{site}"
MAIL_LINK = "mailto:{to}?subject={subject}&body={body}"

INVITATION: Template = (
    ("Subject: Collaboration inquiry - {product} from {company}\n\nHello {name},", None),
    ("\nMy name is {sender} from {company}, a Korean company that makes {product}.", None),
    ("\nI came across your {category} content (@{handle}) and thought it could be a good fit for your audience in {country}.", None),
    ("\nWe would like to send you a free sample and a one-page product sheet, with no obligation. If you are "
     "interested, just reply to this email and I will share the details.", None),
    ("\nIf we work together, we will follow the advertising disclosure rules that apply in {country}.", None),
    ('\nIf you would prefer not to hear from us, reply with "unsubscribe" and we will not contact you again.', None),
    ("\nBest regards,\n{sender}\n{company}\n{email}", None),
)


def fill(template: Template | str, **slots: Column | str) -> Column:
    """The template with its slots filled; a null column makes the result null."""
    blocks = ((template, None),) if isinstance(template, str) else template
    text = "\n".join(block for block, slot in blocks if slot is None or not isinstance(slots[slot], str) or slots[slot])
    parts: list[Column] = []
    for fixed, slot, _, _ in Formatter().parse(text):
        if fixed:
            parts.append(F.lit(fixed))
        if slot is not None:
            value = slots[slot]
            parts.append(F.lit(value) if isinstance(value, str) else value)
    return F.concat(*parts)
