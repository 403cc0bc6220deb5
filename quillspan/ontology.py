"""Document types with their anchors, attribute keys and sensitivity order."""

# Fixed values, in the order that decides ties: (code, category, jurisdictions, English anchors, Spanish anchors).
DOCUMENT_TYPES = [
    ("PASSPORT", "identity", ["US", "CA", "MX"], ["PASSPORT", "TYPE P", "P<"], ["PASAPORTE", "ESTADOS UNIDOS MEXICANOS"]),
    ("US_SSN_CARD", "identity", ["US"], ["SOCIAL SECURITY", "SOCIAL SECURITY ADMINISTRATION"], []),
    ("US_DRIVER_LICENSE", "identity", ["US"], ["DRIVER LICENSE", "DRIVER'S LICENSE", "DL", "USA"], []),
    ("US_EIN_LETTER", "tax", ["US"], ["EMPLOYER IDENTIFICATION NUMBER", "EIN", "CP 575", "INTERNAL REVENUE SERVICE"], []),
    ("US_W2", "income", ["US"], ["W-2", "WAGE AND TAX STATEMENT", "OMB No. 1545-0008"], []),
    ("US_1099", "income", ["US"], ["1099", "NONEMPLOYEE COMPENSATION", "MISCELLANEOUS INCOME"], []),
    ("CA_DRIVER_LICENSE", "identity", ["CA"], ["DRIVER'S LICENCE", "PERMIS DE CONDUIRE"], []),
    ("CA_SIN", "identity", ["CA"], ["SOCIAL INSURANCE NUMBER", "NUMÉRO D'ASSURANCE SOCIALE", "SIN"], []),
    ("CA_T4", "income", ["CA"], ["T4", "STATEMENT OF REMUNERATION", "ÉTAT DE LA RÉMUNÉRATION"], []),
    ("CA_NOA", "tax", ["CA"], ["NOTICE OF ASSESSMENT", "AVIS DE COTISATION", "CRA"], []),
    ("CA_BUSINESS_NUMBER", "tax", ["CA"], ["BUSINESS NUMBER", "NUMÉRO D'ENTREPRISE"], []),
    ("MX_INE", "identity", ["MX"], [], ["INSTITUTO NACIONAL ELECTORAL", "CREDENCIAL PARA VOTAR", "CLAVE DE ELECTOR"]),
    ("MX_CURP", "identity", ["MX"], [], ["CLAVE ÚNICA DE REGISTRO DE POBLACIÓN", "CURP", "RENAPO"]),
    ("MX_RFC_CSF", "tax", ["MX"], [], ["CONSTANCIA DE SITUACIÓN FISCAL", "CÉDULA DE IDENTIFICACIÓN FISCAL", "REGISTRO FEDERAL DE CONTRIBUYENTES", "RFC", "SAT", "idCIF"]),
    ("MX_COMPROBANTE_DOMICILIO", "address", ["MX"], [], ["COMPROBANTE DE DOMICILIO", "CFE", "COMISIÓN FEDERAL DE ELECTRICIDAD", "RECIBO"]),
    ("MX_ACTA_CONSTITUTIVA", "corporate", ["MX"], [], ["ACTA CONSTITUTIVA", "ESCRITURA PÚBLICA", "NOTARIO", "FOLIO MERCANTIL"]),
    ("UTILITY_BILL", "address", ["US", "CA", "MX"], ["UTILITY", "ELECTRIC", "STATEMENT OF ACCOUNT", "ACCOUNT NUMBER"], ["RECIBO", "AGUA", "LUZ", "TELÉFONO"]),
    ("BANK_STATEMENT", "income", ["US", "CA", "MX"], ["STATEMENT", "ACCOUNT SUMMARY", "BEGINNING BALANCE", "IBAN"], ["ESTADO DE CUENTA"]),
]

# Stopwords of the language heuristic.
ENGLISH_WORDS = [
    "the", "and", "of", "to", "in", "is", "was", "for", "with", "this", "that", "are", "be", "by", "on", "as", "at",
    "from", "or", "an", "name", "date", "birth", "address", "number", "issued", "expiry", "expires", "statement",
    "account", "passport", "license", "social", "security", "driver", "income", "tax",
]
SPANISH_WORDS = [
    "el", "la", "los", "las", "de", "del", "y", "en", "es", "un", "una", "con", "por", "para", "que", "se", "su",
    "como", "fecha", "nacimiento", "nombre", "domicilio", "numero", "número", "credencial", "registro", "federal",
    "contribuyentes", "estado", "cuenta", "constancia", "situación", "situacion", "fiscal", "clave", "población",
    "poblacion", "nacional", "electoral",
]

# Canonical attribute keys.
ATTRIBUTE_KEYS = [
    "identity.full_name", "identity.given_names", "identity.surname", "identity.date_of_birth", "identity.sex",
    "identity.nationality", "identity.place_of_birth", "id.passport_number", "id.ssn", "id.itin", "id.sin", "id.curp",
    "id.rfc", "id.ine_clave_elector", "id.driver_license", "id.ein", "id.business_number", "address.residential",
    "address.mailing", "address.registered", "address.postal_code", "income.employer", "income.amount",
    "account.number", "account.balance", "entity.legal_name", "entity.incorporation_date",
    "ownership.beneficial_owner", "ownership.director", "ownership.authorized_signer", "doc.issue_date",
    "doc.expiry_date",
]
MULTI_VALUED_KEYS = ["ownership.director", "ownership.beneficial_owner", "ownership.authorized_signer", "account.number"]

#: From harmless to most sensitive.
SENSITIVITY = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

# Findings that make a document CRITICAL by themselves.
NATIONAL_IDS = [
    "US_SSN", "SSN", "US_ITIN", "CA_SIN", "SIN", "MX_CURP", "CURP", "MX_RFC", "RFC", "MX_INE_CLAVE_ELECTOR",
    "INE_CLAVE_ELECTOR", "PASSPORT", "US_PASSPORT", "US_EIN", "EIN",
]

#: Representations made for every content node.
REPRESENTATIONS = ["hypothetical_q", "proposition", "summary", "alt_phrasing"]


def specificity(anchor: str) -> float:
    """How much one hit of an anchor tells: by its words and length."""
    words, length = len(anchor.split()), len(anchor.strip())
    if words >= 3 or length >= 18:
        return 1.0
    if words >= 2 or length >= 10:
        return 0.6
    return 0.35 if length >= 5 else 0.15


def anchor_rows() -> list[tuple[str, str, str, float]]:
    """(code, language, anchor, weight), types in their order."""
    return [(code, lang, a, specificity(a)) for code, _, _, en, es in DOCUMENT_TYPES for lang, group in (("en", en), ("es", es)) for a in group]
