"""Place names as they are written in movements, and what each one stands for."""

# Spelling | standard name | I international, N national.
# An empty standard name marks a spelling that is known to say nothing.
PLACES = """
ALBANIA|ALBANIA|I
ALEMANIA|ALEMANIA|I
ANDORRA|ANDORRA|I
ARGENTINA|ARGENTINA|I
ARUBA|ARUBA|I
AUSTRALIA|AUSTRALIA|I
AUSTRIA|AUSTRIA|I
AZERBAIYÁN|AZERBAIYAN|I
BELGICA|BELGICA|I
BÉLGICA|BELGICA|I
BIELORRUSIA|BIELORRUSIA|I
BOLIVIA, ESTADO PLURINACIONAL DE|BOLIVIA|I
BRASIL|BRASIL|I
BULGARIA|BULGARIA|I
CAMBOYA|CAMBOYA|I
CANADA|CANADA|I
CANADÁ|CANADA|I
CHILE|CHILE|I
CHINA|CHINA|I
CHIPRE|CHIPRE|I
CIUDAD DEL VATICANO|CIUDAD DEL VATICANO|I
COREA DEL SUR|COREA DEL SUR|I
COSTA RICA|COSTA RICA|I
CROACIA|CROACIA|I
CUBA|CUBA|I
CURAÇAO|CURAZAO|I
CURAZAO|CURAZAO|I
DINAMARCA|DINAMARCA|I
ECUADOR|ECUADOR|I
EGIPTO|EGIPTO|I
EL SALVADOR|EL SALVADOR|I
EMIRATOS ARABES UNIDOS|EMIRATOS ARABES UNIDOS|I
EMIRATOS ÁRABES UNIDOS|EMIRATOS ARABES UNIDOS|I
ESLOVAQUIA|ESLOVAQUIA|I
ESPANA|ESPANA|I
ESPAÑA|ESPANA|I
ESTADOS UNIDOS|ESTADOS UNIDOS|I
ESTONIA|ESTONIA|I
FILIPINAS|FILIPINAS|I
FINLANDIA|FINLANDIA|I
FRANCIA|FRANCIA|I
GHANA|GHANA|I
GIBRALTAR|GIBRALTAR|I
GRECIA|GRECIA|I
GUATEMALA|GUATEMALA|I
HONDURAS|HONDURAS|I
HONG KONG|HONG KONG|I
HUNGRIA|HUNGRIA|I
HUNGRÍA|HUNGRIA|I
INDIA|INDIA|I
INDONESIA|INDONESIA|I
IRLANDA|IRLANDA|I
ISLANDIA|ISLANDIA|I
ISLAS TURCAS Y CAICOS|ISLAS TURCAS Y CAICOS|I
ISRAEL|ISRAEL|I
ITALIA|ITALIA|I
JAMAICA|JAMAICA|I
JAPON|JAPON|I
JORDANIA|JORDANIA|I
KAZAJISTAN|KAZAJISTAN|I
KENIA|KENIA|I
LAO, REPUBLICA DEMOCRATICA POPULAR|LAOS|I
LETONIA|LETONIA|I
LIECHTENSTEIN|LIECHTENSTEIN|I
LITUANIA|LITUANIA|I
LUXEMBURGO|LUXEMBURGO|I
MALASIA|MALASIA|I
MALTA|MALTA|I
MARRUECOS|MARRUECOS|I
MEXICO|MEXICO|I
MÉXICO|MEXICO|I
MOLDAVIA, REPUBLICA DE|MOLDAVIA|I
MOLDAVIA, REPÚBLICA DE|MOLDAVIA|I
MONACO|MONACO|I
MONTENEGRO|MONTENEGRO|I
NIGERIA|NIGERIA|I
NORUEGA|NORUEGA|I
NUEVA ZELANDA|NUEVA ZELANDA|I
PAISES BAJOS|PAISES BAJOS|I
PAÍSES BAJOS|PAISES BAJOS|I
PALESTINA, ESTADO DE|PALESTINA|I
PANAMA|PANAMA|I
PANAMÁ|PANAMA|I
PARAGUAY|PARAGUAY|I
PERU|PERU|I
PERÚ|PERU|I
POLONIA|POLONIA|I
PORTUGAL|PORTUGAL|I
PUERTO RICO|PUERTO RICO|I
QATAR|QATAR|I
REINO UNIDO|REINO UNIDO|I
REPUBLICA CHECA|REPUBLICA CHECA|I
REPÚBLICA CHECA|REPUBLICA CHECA|I
REPUBLICA DOMINICANA|REPUBLICA DOMINICANA|I
REPÚBLICA DOMINICANA|REPUBLICA DOMINICANA|I
REUNIÓN|REUNION|I
RUANDA|RUANDA|I
RUMANIA|RUMANIA|I
RUSIA|RUSIA|I
RUSIA, FEDERACIÓN DE|RUSIA|I
SAN MARTIN (PARTE FRANCESA)|SAN MARTIN|I
SINGAPUR|SINGAPUR|I
SUDAFRICA|SUDAFRICA|I
SUECIA|SUECIA|I
SUIZA|SUIZA|I
TAILANDIA|TAILANDIA|I
TAIWAN, PROVINCIA DE CHINA|TAIWAN|I
TANZANIA, REPUBLICA UNIDA DE|TANZANIA|I
TURQUIA|TURQUIA|I
TURQUÍA|TURQUIA|I
UCRANIA|UCRANIA|I
UGANDA|UGANDA|I
URUGUAY|URUGUAY|I
VENEZUELA, REPUBLICA BOLIVARIANA DE|VENEZUELA|I
VENEZUELA, REPÚBLICA BOLIVARIANA DE|VENEZUELA|I
VIET NAM|VIET NAM|I
ZAMBIA|ZAMBIA|I
ARMENIA|ARMENIA|N
BARRANCABERMEJA|BARRANCABERMEJA|N
BARRANQUILLA|BARRANQUILLA|N
BOGOTA D.C|BOGOTA|N
BOGOTA D.C.|BOGOTA|N
BOGOTÁ D.C.|BOGOTA|N
BUCARAMANGA|BUCARAMANGA|N
CALI|CALI|N
CARTAGENA|CARTAGENA|N
CUCUTA|CUCUTA|N
CÚCUTA|CUCUTA|N
GIRON|GIRON|N
GIRÓN|GIRON|N
IBAGU?|IBAGUE|N
IBAGUE|IBAGUE|N
IBAGUÉ|IBAGUE|N
MEDELLIN|MEDELLIN|N
NEIVA|NEIVA|N
PEREIRA|PEREIRA|N
SAN GIL|SAN GIL|N
VILLAVICENCIO|VILLAVICENCIO|N
#N/D||
"""

# National places with a risk tier of their own.
TIER_OF_CITY = {
    "ARMENIA": "jurisdiccion_4",
    "BARRANCABERMEJA": "jurisdiccion_4",
    "BARRANQUILLA": "jurisdiccion_4",
    "BOGOTA": "jurisdiccion_5",
    "BUCARAMANGA": "jurisdiccion_4",
    "CALI": "jurisdiccion_5",
    "CARTAGENA": "jurisdiccion_3",
    "CUCUTA": "jurisdiccion_3",
    "GIRON": "jurisdiccion_4",
    "IBAGUE": "jurisdiccion_4",
    "MEDELLIN": "jurisdiccion_5",
    "NEIVA": "jurisdiccion_5",
    "PEREIRA": "jurisdiccion_4",
    "SAN GIL": "jurisdiccion_4",
    "VILLAVICENCIO": "jurisdiccion_5",
}
TIER_INTERNATIONAL = "jurisdiccion_6"
TIER_OTHER = "jurisdiccion_0"


def place_rows() -> list[tuple[str, str | None, str | None]]:
    rows = (line.split("|") for line in PLACES.strip().splitlines())
    return [(spelling, name or None, flag or None) for spelling, name, flag in rows]
