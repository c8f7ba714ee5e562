"""Lines that the driver's tables do not have."""

LITERALS = [
    (1, "प्रश्न 1. सही विकल्प चुनिए (5)"),
    (2, "कौन सा शब्द सही है? _____"),
    (3, "क) नदी ख) पहाड़ ग) सागर"),
    (4, "राम और श्याम 12 बजे गए, फिर आए।"),
    (5, "Mixed हिन्दी and English - 3"),
    (6, ""),
]
