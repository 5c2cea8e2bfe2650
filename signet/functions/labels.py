"""What codes are called on a screen: one lookup for each vocabulary, as a map literal that Spark folds into the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that users of these codes see.
ONBOARDING_VERDICTS = {"READY": "Onaya hazır", "CO_SIGNER_REQUIRED": "İkinci imza gerekli", "MISMATCH": "Bilgiler uyuşmuyor", "REGISTRY_CONFLICT": "Sicil kaydıyla çelişiyor"}
ONBOARDING_COLOURS = {"READY": "green", "CO_SIGNER_REQUIRED": "amber", "MISMATCH": "red", "REGISTRY_CONFLICT": "red"}
TRANSACTION_VERDICTS = {"ALLOWED": "İşlem onaylandı", "PENDING_COSIGN": "İkinci imza bekleniyor", "DENIED": "İşlem reddedildi"}
STATUS_SYMBOLS = {"green": "✓", "amber": "!", "red": "×"}
STATUSES = {"green": "Uygun", "amber": "Dikkat", "red": "Engel"}
APPLICATION_STATES = {
    "DRAFT": "Taslak — kimlik doğrulanmadı",
    "IDENTITY_VERIFIED": "Kimlik doğrulandı",
    "DOCUMENT_SCANNED": "Belge tarandı",
    "ANALYZING": "Analiz ediliyor",
    "ANALYZED": "Analiz tamamlandı",
    "APPROVED": "Onaylandı",
    "DOC_REQUESTED": "Yeni belge istendi",
    "ESCALATED": "Uyum birimine iletildi",
    "ANALYSIS_FAILED": "Analiz başarısız",
}
SUBJECTS = {"GENERAL": "Genel işlem", "CREDIT": "Kredi kullanımı", "REAL_ESTATE": "Gayrimenkul"}
MODES = {"SOLE": "Münferit", "JOINT": "Müşterek", "LIMITED": "Sınırlı", "UNKNOWN": "Belirsiz"}
SCOPES = {"general": "Genel işlemler", "credit": "Kredi işlemleri", "real_estate": "Gayrimenkul işlemleri"}
ACTIONS = {
    "APPLICATION_CREATED": "Başvuru oluşturuldu",
    "IDENTITY_ATTESTED": "Kimlik doğrulandı",
    "DOCUMENT_UPLOADED": "Belge yüklendi",
    "ANALYSIS_STARTED": "Belge incelemesi başladı",
    "ANALYSIS_COMPLETED": "Belge incelemesi tamamlandı",
    "ANALYSIS_FAILED": "Belge incelemesi tamamlanamadı",
    "EXTRACTION_CORRECTED": "Belge bilgisi düzeltildi",
    "APPLICATION_DECIDED": "Başvuru kararı kaydedildi",
    "APPROVAL_OVERRIDE": "İstisnai onay verildi",
    "AUTHORITY_CREATED": "Yetki kaydı oluşturuldu",
    "AUTHORITY_SUSPENDED": "Yetki kaydı askıya alındı",
    "REGISTRY_REPRESENTATIVE_UPDATED": "Temsilci sicil durumu güncellendi",
    "TRANSACTION_AUTHORIZED": "İşlem yetkisi kontrol edildi",
    "TRANSACTION_COSIGNED": "İkinci imza tamamlandı",
}
OTHER_ACTION, OTHER_ACTOR = "Kayıt güncellendi", "Yetkili kullanıcı"
ACTORS = {"branch_user:": "Şube görevlisi", "system": "Sistem", "mobile_user:": "Mobil kullanıcı"}


def shown(code: Column, words: dict[str, str], other: str | None = None) -> Column:
    """``code`` in ``words``; one that isn't there, or null, is ``other``, or itself where none is given."""
    found = F.try_element_at(F.create_map(*(F.lit(x) for pair in words.items() for x in pair)), code)
    return F.coalesce(found, F.lit(other) if other is not None else code)


def action(code: Column) -> Column:
    return shown(code, ACTIONS, OTHER_ACTION)


def actor(name: Column) -> Column:
    """Who acted, by how the name begins; null and all others are some user with rights."""
    kinds = (F.when(name.startswith(prefix), F.lit(word)) for prefix, word in ACTORS.items())
    return F.coalesce(*kinds, F.lit(OTHER_ACTOR))


def verdict_badge(verdict: Column) -> Column:
    """(label, symbol, status) of an application's verdict; an unknown verdict is its own label, without a colour."""
    colour = shown(verdict, ONBOARDING_COLOURS, "")
    known = colour != ""
    return F.struct(shown(verdict, ONBOARDING_VERDICTS).alias("label"), F.when(known, shown(colour, STATUS_SYMBOLS)).alias("symbol"), F.when(known, shown(colour, STATUSES)).alias("status"))
