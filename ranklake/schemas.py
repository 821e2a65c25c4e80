"""Declared schemas: nothing is inferred."""

RESULT_FIELDS = (
    "name string, club string, timeText string, status string, rank int, timeS int, timeBehindS int, yearOfBirth int, userId string, note string, "
    "championship string, resultKind string, outOfCompetition boolean, teamNumber string, teamName string, teamStatus string, teamTimeText string, "
    "teamTimeS int, individualStatus string, leg int, legCount int, memberlessTeam boolean, identityExcluded boolean, excludedFromDeclaredCount boolean, "
    "preserveRepeatedRelayLeg boolean, scoreText string, scorePoints string, rankingBasis string, sourceBib string, sourceJg string, sourceControls int, "
    "sourceNat string, sourceCourse string, rawStatusCode int"
)
CATEGORY = (
    "name string, sourceCategory string, declaredStarters int, sourceUnitCount int, courseLengthM int, courseClimbM int, courseControls int, "
    f"rankingBasis string, results array<struct<{RESULT_FIELDS.replace(' ', ':').replace(',:', ',')}>>"
)
_CATEGORY = CATEGORY.split(", results ")[0].replace(", ", ",").replace(" ", ":") + ",results:" + CATEGORY.split(", results ")[1].strip()
DOCUMENT = (
    "eventId long, source string, sourceUrl string, fileName string, listType string, docDate string, docTitle string, "
    f"categories array<struct<{_CATEGORY}>>, "
    f"stageDocuments array<struct<stageNumber:int,stageDate:string,stageTitle:string,listType:string,categories:array<struct<{_CATEGORY}>>>>"
)
API_ROW = (
    "id long, userId string, firstName string, lastName string, yearOfBirth int, nationality string, clubName string, clubCode string, "
    "categoryShortTitle string, categoryTitle string, categoryStatus string, classification string, rank double, time double, timeBehind double, "
    "outOfCompetition boolean, resultType string, resultListMode string, eventStageId long, scorePoints string, updatedAt string, teamName string, "
    "course struct<length:int,climb:int,controlCount:int>, championship array<struct<championshipShortName:string>>, "
    "teamMembers array<struct<userId:string,firstName:string,lastName:string,yearOfBirth:int,nationality:string,leg:int,classification:string,overall:struct<time:double,classification:string>>>"
)
EVENT = "id long, slug string, shortTitle string, title string, dateFrom string, dateTo string, location string, competitionType string, sportType string, eventType string, url string, stageCount int, hasOfficialResults boolean, visibility string, status string"
STAGE = "id long, eventId long, number int, title string, dateFrom string, dateTo string, location string"
CLUB = "code string, name string"
JURISDICTION = "clubs array<struct<club:string,jurisdiction:string,valid_from:string,valid_to:string>>"
USERS = "schema_version int, fetched_at string, users array<struct<user_id:long,first_name:string,last_name:string,year_of_birth:int,gender:string,nationality:string,is_verified:boolean,active_memberships:array<struct<club:struct<name:string,code:string>,sport_type:string,date_from:string,date_to:string,active:boolean>>>>"
LEDGER = "person_id long, event_id long, decision string"
MEMBERS = "member_id long, name string, birth_year int, club string"
